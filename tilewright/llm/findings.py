"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a long run of token characters with a digit, or whatever is assigned to the name of
a credential, of any length and make-up. The forest sees its length and
make-up, its character transitions against those of ordinary words, how much of it dictionary
words cover, the path it was found under and the words next to it. It is trained on labelled
findings. Dictionary and transitions are counted over all documents.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import cut, small

#: Whole runs of token characters; they are candidates if they hold a digit.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/.@~\-])[A-Za-z0-9_+/.@~\-]{12,}={0,2}")
DIGIT = re.compile("[0-9]")
ASSIGNED = re.compile(r"([A-Za-z_][A-Za-z0-9_.\-]{0,63})[\"']?[ \t]*[=:]>?[ \t]*(?i:(?:bearer|basic)[ \t]+)?[\"']?$")
WORD = re.compile(r"[^\W\d_]+")
#: Words that credentials are named by; fixed by usage.
NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "private")
#: A value after such a name: quoted, or up to the next white space. Authors are no credentials.
NAMED_VALUE = re.compile(
    rf"(?:{'|'.join(NAMES).replace('auth', 'auth(?!or(?!i[sz])|ent)')})[A-Za-z0-9_.\-]{{0,40}}[\"']?[ \t]*[=:]>?[ \t]*"
    r"(?:(?:bearer|basic)[ \t]+)?(?:\"([^\"\n]+)\"|'([^'\n]+)'|[\"']?([^\s\"'][^\s]*))", re.I)
#: What ends a sentence, a list or a bracket around a bare value is not part of it.
AFTER_BARE = ".,;:)]}>\"'"
OPENS = {")": "(", "]": "[", "}": "{", ">": "<"}
#: Places where code or a form stands for the value.
PLACEHOLDER = re.compile(r"\$\{?\w+\}?|\$\(.*|<.*|\{\{?.*|%\(?\w+\)?s?|\*+|x{3,}|\.{2,}|null|none|nil|true|false|undefined", re.I)
#: Path parts that often hold examples instead of real credentials.
EXAMPLES = ("test", "example", "sample", "doc", "fixture", "mock", "demo")
#: Characters looked at on either side of a candidate for its neighbours.
REACH = 64
#: The dictionary: this many words of 3 to 6 letters, by their count in all documents.
DICTIONARY_WORDS = 5000
#: At most so many labelled findings of each kind train the forest.
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 30, 8, 17
MASK = "[SECRET]"
FEATURES = (
    "length", "digits", "upper", "lower", "marks", "entropy", "distinct", "hex", "transitions", "switches", "coverage", "at", "dots",
    "assigned", "named", "near_name", "quoted", "before_known", "after_known", "path_depth", "path_example", "path_bucket", "equals",
)
#: Stand-ins of each label that show the forest assigned values of all lengths and make-ups.
STANDINS = 2000
#: Values that are replaced wherever they stand in a text; others, which can be ordinary words, at their own places.
WIDE = r"^(?=.*[0-9])(?=.*[A-Za-z]).{8,}$|^(?=[A-Za-z_+/.@~\-]*[0-9])[A-Za-z0-9_+/.@~\-]{12,}={0,2}$"


class Language(NamedTuple):
    words: frozenset[str]
    transitions: np.ndarray  # log probabilities between a-z and anything else


def learn_language(docs: DataFrame) -> Language:
    """Dictionary and letter transitions from every text."""
    words = (
        docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word"))
        .filter(F.length("word").between(3, 6) & F.col("word").rlike("^[a-z]+$"))
        .groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS).collect()
    )
    counts = np.ones((27, 27))
    for r in words:
        at = [26, *(ord(c) - 97 for c in r["word"]), 26]
        np.add.at(counts, (at[:-1], at[1:]), r["count"])
    return Language(frozenset(r["word"] for r in words), np.log(counts / counts.sum(axis=1, keepdims=True)))


def coverage(value: str, words: frozenset[str]) -> float:
    """Share of the characters inside dictionary words, the longest taken first from each place."""
    low, i, covered = value.lower(), 0, 0
    while i < len(low):
        n = next((n for n in range(6, 2, -1) if low[i : i + n] in words), 0)
        covered += n
        i += n or 1
    return covered / len(value)


def describe(value: str, before: str, after: str, path: str, language: Language) -> list[float]:
    """The features, in the order of ``FEATURES``."""
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "m" for c in value]
    count = Counter(kinds)
    chars = Counter(value)
    letters = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in value.lower()]
    key = ASSIGNED.search(before)
    name = key[1].lower() if key else ""
    near = f"{before} {after}".lower()
    words_before, words_after = WORD.findall(before), WORD.findall(after)
    return [
        float(n), count["d"] / n, count["u"] / n, count["l"] / n, count["m"] / n,
        -sum(k / n * math.log2(k / n) for k in chars.values()), len(chars) / n,
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None),
        float(language.transitions[letters[:-1], letters[1:]].mean()) if n > 1 else 0.0,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, coverage(value, language.words), float(value.count("@")), value.count(".") / n,
        float(bool(key)), float(any(w in name for w in NAMES)), float(any(w in near for w in NAMES)), float(before[-1:] in ("'", '"')),
        float(bool(words_before) and words_before[-1].lower() in language.words), float(bool(words_after) and words_after[0].lower() in language.words),
        float(path.count("/")), float(any(w in path.lower() for w in EXAMPLES)), float(zlib.crc32(path.encode()) % 16),
        float(bool(key) and "=" in key[0]),
    ]


def label(value: str, before: str) -> int | None:
    """What is known without the forest: 1 for published credential formats and named hex keys, 0
    for numbers, addresses and hosts, None if neither. Stands in for reviewers' labels."""
    key = ASSIGNED.search(before)
    if re.fullmatch(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z\-]{10,}", value):
        return 1
    if key and any(w in key[1].lower() for w in NAMES) and re.fullmatch(r"[0-9a-f]{16,}", value):
        return 1
    if PLACEHOLDER.fullmatch(value):
        return 0
    if re.fullmatch(r"[0-9.\-]+|[^@]+@[^@]+\.[A-Za-z]+|(?:[A-Za-z0-9\-]+\.)+[a-z]{2,}", value):
        return 0
    return None


def candidates(text: str) -> list[tuple[int, str]]:
    """Places and values, in order; a place and value that both ways give counts once."""
    found = {(m.start(), m.group()) for m in CANDIDATE.finditer(text) if DIGIT.search(m.group())}
    for m in NAMED_VALUE.finditer(text):
        value = m[m.lastindex]
        if m.lastindex == 3:
            end = len(value)
            closing = {c for c in AFTER_BARE if OPENS.get(c, "\n") not in value}
            while end and value[end - 1] in closing:
                end -= 1
            value = value[:end] or value
        found.add((m.start(m.lastindex), value))
    return sorted(found)


def standins(language: Language, n: int = STANDINS) -> list[tuple[list[float], float]]:
    """Features and labels of ``n`` made-up findings of each label; the same every time."""
    rng = random.Random(SEED)
    lower, digits, marks = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!#$%&*@^?+-_"
    every = lower + lower.upper() + digits
    words = sorted(language.words)[:: max(1, len(language.words) // 500)] or ["the", "of", "house", "light", "thing"]
    draw = lambda of, least, most: "".join(rng.choices(of, k=rng.randint(least, most)))
    word = lambda: rng.choice(words)
    names = ["password", "passwd", "pwd", "DB_PASSWORD", "secret", "client_secret", "token", "auth_token", "api_key", "apikey", "access_key", "private_key"]
    tight = ["{}=", '{}="', "{}='", '{} = "', "{} = ", '"{}": "', "{}: '", "{}:", "{}: ", "Authorization: Bearer "]
    good = [
        lambda: draw(every, 6, 11), lambda: draw(every + digits, 8, 40), lambda: draw(every + marks * 3, 6, 16), lambda: draw(lower + lower.upper(), 7, 16), lambda: draw("0123456789abcdef", 8, 40),
        lambda: word() + draw(digits, 1, 4) + rng.choice(["", *marks]), lambda: word().replace("e", "3").replace("o", "0") + rng.choice(marks) + draw(every, 2, 5),
    ]
    worded = [lambda: word() + word(), lambda: word() + word() + word(), lambda: draw(lower, 6, 12)]
    bad = [
        word, lambda: word().capitalize(), lambda: draw(digits, 1, 6), lambda: rng.choice(["yes", "no", "none", "null", "true", "false", "optional", "required", "string"]),
        lambda: f"${{{word().upper()}}}", lambda: f"<{word()}>", lambda: f"get_{word()}()", lambda: f"self.{word()}", lambda: f"{{{{ {word()} }}}}", lambda: "*" * rng.randint(3, 10),
    ]
    plain = [lambda: draw(digits, 12, 19), lambda: f"{word()}.{draw(digits, 1, 3)}@{word()}.com", lambda: f"www{draw(digits, 1, 2)}.{word()}{word()}.com", lambda: f"20{draw(digits, 2, 2)}-{draw(digits, 2, 2)}-{draw(digits, 2, 2)}-{draw(digits, 2, 2)}"]
    out = []
    for k in range(2 * n):
        is_secret, kind = k % 2, rng.random()
        name = rng.choice(tight if is_secret or kind < 0.3 else ["{}: ", "{} : ", "{}: ", "{} = "]).format(rng.choice(names))
        if is_secret:
            value, name = (rng.choice(worded)(), rng.choice(tight[:4]).format(rng.choice(names))) if kind < 0.25 else (rng.choice(good)(), name if kind < 0.9 else name.rstrip("'\"") + " ")
            if kind > 0.95:
                value, name = " ".join(word() for _ in range(rng.randint(3, 5))), f'{rng.choice(names)} = "'
        else:
            value, name = (rng.choice(plain)(), "") if kind > 0.8 else (rng.choice(bad[2:] if kind < 0.3 else bad)(), name)
        before = f"{word()} {word()} {word()} {name}"
        after = (before[-1] if before[-1] in "'\"" else "") + f" {word()} {word()}"
        out.append((describe(value, before, after, rng.choice(["", f"src{k % 40}", "src/main/conf.py", "tests/a.py"]), language), float(is_secret)))
    return out


SCHEMA = "doc_id long, key long, start long, value string, features array<double>, label int"


def scan(docs: DataFrame, language: Language) -> DataFrame:
    """Candidates of ``docs(doc_id, text, source)``: their document (``doc_id``, and ``key`` made of id and
    text), place in code points, value, features, and label if known. Whole texts are read."""
    shared = docs.sparkSession.sparkContext.broadcast(language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small(batches):
            out = []
            for doc_id, key, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text", "path")), strict=True):
                for start, value in candidates(text or ""):
                    end = start + len(value)
                    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
                    out.append((doc_id, key, start, value, describe(value, before, after, path or "", known), label(value, before)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("path")
    )
    return narrow.mapInArrow(run, SCHEMA)


def text_key() -> Column:
    """The same for rows with the same id and text only."""
    return F.xxhash64("doc_id", "text")


def train(labelled: DataFrame, *, rows: int = TRAINING_ROWS, more: list[tuple[list[float], float]] = ()) -> RandomForestClassificationModel | None:
    """A forest from ``labelled(features, label)``; None unless both labels occur.

    At most ``rows`` of each label are used, those with the smallest hash of key and place, so the
    sample does not depend on partitioning. ``more``: features and labels besides them.
    """
    order = [F.xxhash64("key", "start"), F.col("value")]
    parts = [labelled.filter(F.col("label") == k).select("key", "start", "value", "features", "label").orderBy(*order).limit(rows) for k in (0, 1)]
    rows_of = parts[0].union(parts[1]).select("features", F.col("label").cast("double").alias("label"))
    if more:
        rows_of = rows_of.union(labelled.sparkSession.createDataFrame(more, "features array<double>, label double"))
    sample = cut(rows_of.select(array_to_vector("features").alias("vector"), "label"))
    if {r["label"] for r in sample.select("label").distinct().collect()} != {0.0, 1.0}:
        return None
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(sample)


def held_out() -> Column:
    """A fixed quarter of the documents, never trained on."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of ``docs(doc_id, text, source)`` with ``probability`` and ``is_secret``.

    ``labelled``: findings with ``key, start, value, features, label`` to train on; by default the
    candidates whose format is known, outside the held-out documents, and ``standins``. Nulls: a null text has no
    candidate, a null source is an empty path. If given labels are all alike there is no forest, and
    known formats decide. Repeated rows: one result each. Empty table: empty result.
    """
    language = learn_language(docs)
    found = cut(scan(docs, language))
    if labelled is None:
        model = train(found.filter(F.col("label").isNotNull() & ~held_out()), more=standins(language))
    else:
        model = train(labelled)
    if model is None:
        scored = found.withColumn("probability", F.coalesce(F.col("label").cast("double"), F.lit(0.0)))
    else:
        scored = model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn(
            "probability", vector_to_array("probability")[1]
        )
    return scored.select(
        "doc_id", "key", "start", "value", "features", "label", held_out().alias("held_out"), "probability", (F.col("probability") > 0.5).alias("is_secret")
    )


def report(docs: DataFrame) -> DataFrame:
    """Findings without the secrets themselves: a digest stands for the value."""
    return find_secrets(docs).select(
        "doc_id", "start", F.char_length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"),
        "label", "held_out", F.round("probability", 6).alias("probability"), "is_secret",
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]`` and ``n_chars`` counted anew; no row goes.

    Every finding is replaced at its place, from the last to the first. Values in ``WIDE`` are then
    replaced wherever they stand in the text, longest first. Texts are read whole, in time linear in
    their length. Other columns pass unchanged, whatever their names. Nulls and repeated rows: as in
    ``find_secrets``; empty table: empty result.
    """
    size = F.char_length("value").alias("n")
    per_text = (
        find_secrets(docs).filter("is_secret").groupBy("key")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", F.char_length("value").cast("long").alias("n"))), asc=False).alias("_places"),
            F.sort_array(F.collect_set(F.when(F.col("value").rlike(WIDE), F.struct(size, "value"))), asc=False).alias("_secrets"),
        )
        .select(F.col("key").alias("_key"), "_places", "_secrets")
    )
    # Plain numbers for names, so that no column of the input can clash with the new ones.
    places = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    numbered = docs.toDF(*places.values()).withColumn("_own", F.xxhash64(places["doc_id"], places["text"]))
    joined = numbered.join(per_text, F.col("_own") == F.col("_key"), "left")

    def masked(done: Column, place: Column) -> Column:
        # What overlaps a later finding reaches up to it only.
        length = F.least(place["n"], done["until"] - place["start"]).cast("int")
        text = F.overlay(done["text"], F.lit(MASK), (place["start"] + 1).cast("int"), length)
        return F.struct(text.alias("text"), place["start"].alias("until"))

    whole = F.col(places["text"])
    first = F.struct(whole.cast("string").alias("text"), F.lit(2**31 - 1).cast("long").alias("until"))
    at_places = F.aggregate("_places", first, masked, lambda done: done["text"])
    text = F.when(
        F.col("_secrets").isNotNull(), F.aggregate("_secrets", at_places, lambda t, s: F.replace(t, s["value"], F.lit(MASK)))
    ).otherwise(whole)
    cleaned = joined.withColumn(places["text"], text)
    if "n_chars" in docs.columns:
        size = F.length(places["text"]).cast(docs.schema["n_chars"].dataType)
        cleaned = cleaned.withColumn(places["n_chars"], F.when(F.col("_secrets").isNotNull(), size).otherwise(F.col(places["n_chars"])))
    return cleaned.select(*places.values()).toDF(*docs.columns)


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
