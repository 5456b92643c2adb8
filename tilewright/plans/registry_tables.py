"""Registered queries over catalogue-like tables, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import naming
from tilewright.operators import annotation, batches, catalogue, overlays, splits, training_log
from tilewright.plans import standins as s
from tilewright.sources import runs, synthetic

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


# --- names ------------------------------------------------------------------------------------

SQL_PART_FILES = """
files AS (
  SELECT p_partkey, '/raw/' || replace(p_name, ' ', '.') || '_' || p_partkey ||
         CASE p_partkey % 5 WHEN 0 THEN '_4x' WHEN 1 THEN '_10x' WHEN 2 THEN '_20x'
                            WHEN 3 THEN '_4x_extra' ELSE '' END ||
         CASE p_partkey % 7 WHEN 0 THEN '.png' WHEN 1 THEN '.TIF' WHEN 2 THEN '.jpeg'
                            WHEN 3 THEN '.txt' WHEN 4 THEN '.v2.png' WHEN 5 THEN '.tiff' ELSE '.Jpg' END
         AS path
  FROM part),
named AS (
  SELECT p_partkey, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM files),
stems AS (
  SELECT *, regexp_replace(name, '^(.+)\\.[^.]+$', '\\1') AS stem,
         lower(regexp_extract(name, '^.+\\.([^.]+)$', 1)) AS ext
  FROM named)"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    mark = (
        F.when(key % 5 == 0, "_4x")
        .when(key % 5 == 1, "_10x")
        .when(key % 5 == 2, "_20x")
        .when(key % 5 == 3, "_4x_extra")
        .otherwise("")
    )
    end = (
        F.when(key % 7 == 0, ".png")
        .when(key % 7 == 1, ".TIF")
        .when(key % 7 == 2, ".jpeg")
        .when(key % 7 == 3, ".txt")
        .when(key % 7 == 4, ".v2.png")
        .when(key % 7 == 5, ".tiff")
        .otherwise(".Jpg")
    )
    dotted = F.replace(F.col("p_name"), F.lit(" "), F.lit("."))
    path = F.concat(F.lit("/raw/"), dotted, F.lit("_"), key.cast("string"), mark, end)
    return s.table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))


@query(
    f"""WITH {SQL_PART_FILES}
SELECT p_partkey, name, stem, ext, ext IN ('png','jpg','jpeg','tif','tiff') AS supported,
       {s.sql_magnification('stem')} AS magnification,
       CASE WHEN {s.sql_magnification('stem')} = 'unknown' THEN '' ELSE {s.sql_magnification('stem')} END
         AS magnification_or_blank
FROM stems"""
)
def file_names(spark, sf_dir):
    """Stem, extension filter and magnification from names."""
    path = F.col("path")
    return part_files(spark, sf_dir).select(
        "p_partkey",
        naming.base_name(path).alias("name"),
        naming.stem(path).alias("stem"),
        naming.extension(path).alias("ext"),
        naming.is_supported_image(path).alias("supported"),
        naming.magnification(path).alias("magnification"),
        naming.magnification_or(path, "").alias("magnification_or_blank"),
    )


def _part_rows(spark, sf_dir):
    files = part_files(spark, sf_dir).filter(naming.is_supported_image(F.col("path")))
    return catalogue.metadata_rows(files.select(naming.base_name(F.col("path")).alias("name")))


SQL_PART_ROWS = f"""{SQL_PART_FILES},
meta AS (
  SELECT name AS image, CASE WHEN {s.sql_magnification('stem')} = 'unknown' THEN ''
                             ELSE {s.sql_magnification('stem')} END AS magnification, '' AS condition
  FROM stems WHERE ext IN ('png','jpg','jpeg','tif','tiff'))"""


@query(f"WITH {SQL_PART_ROWS} SELECT * FROM meta")
def metadata_rows(spark, sf_dir):
    """One metadata row per supported file."""
    return _part_rows(spark, sf_dir)


@query(f"WITH {SQL_PART_ROWS} SELECT * FROM meta WHERE magnification = ''")
def unrecognised_magnification(spark, sf_dir):
    """P5: rows to complete by hand."""
    return catalogue.unrecognised(_part_rows(spark, sf_dir))


@query(
    f"""WITH {SQL_PART_ROWS}
SELECT CASE WHEN magnification = '' THEN 'unspecified' ELSE magnification END AS magnification,
       count(*) AS n FROM meta GROUP BY 1"""
)
def magnification_counts(spark, sf_dir):
    """A4: rows per magnification."""
    return catalogue.magnification_counts(_part_rows(spark, sf_dir))


# --- pairing ----------------------------------------------------------------------------------


def _raw_files(spark, sf_dir):
    """Raw side: every document, every tenth also under a second folder."""
    docs = s.table(spark, sf_dir, "documents").select("doc_id", "source")
    copies = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return docs.select(
        name.alias("image_id"),
        F.explode(copies).alias("c"),
        "source",
        name.alias("n"),
    ).select("image_id", F.concat(F.lit("/raw/"), "c", F.lit("/"), "source", F.lit("/"), "n", F.lit(".tif")).alias("path"))


def _mask_files(spark, sf_dir):
    """Mask side: every label, every seventh twice; some belong to no document."""
    rows = s.table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 10_000_000).otherwise(0)).alias("d"))
    copies = F.when(F.col("d") % 7 == 0, F.array(F.lit("png"), F.lit("tif"))).otherwise(F.array(F.lit("png")))
    name = F.concat(F.lit("doc_"), F.col("d").cast("string"))
    return rows.select(name.alias("image_id"), F.explode(copies).alias("e")).select(
        "image_id", F.concat(F.lit("/masks/"), "image_id", F.lit("."), "e").alias("path")
    )


SQL_SIDES = """
raw AS (
  SELECT 'doc_' || doc_id AS image_id, '/raw/' || c || '/' || source || '/doc_' || doc_id || '.tif' AS path
  FROM (SELECT doc_id, source, unnest(CASE WHEN doc_id % 10 = 0 THEN ['a','b'] ELSE ['a'] END) AS c FROM documents)),
lab AS (SELECT doc_id + CASE WHEN doc_id % 11 = 0 THEN 10000000 ELSE 0 END AS d FROM labels),
masks AS (
  SELECT 'doc_' || d AS image_id, '/masks/doc_' || d || '.' || e AS path
  FROM (SELECT d, unnest(CASE WHEN d % 7 = 0 THEN ['png','tif'] ELSE ['png'] END) AS e FROM lab))"""

SQL_PAIRS = f"""{SQL_SIDES},
raw1 AS (SELECT image_id, max(path) AS raw_path, count(*) AS n_raw FROM raw GROUP BY 1),
maskn AS (SELECT image_id, count(*) AS n_mask FROM masks GROUP BY 1),
pairs AS (
  SELECT m.image_id, raw_path, m.path AS mask_path, n_raw > 1 OR n_mask > 1 AS duplicate_stem
  FROM masks m JOIN raw1 USING (image_id) JOIN maskn USING (image_id))"""


@query(f"WITH {SQL_PAIRS} SELECT * FROM pairs")
def pairing(spark, sf_dir):
    """Raw and mask files joined by stem."""
    return catalogue.pair_files(_raw_files(spark, sf_dir), _mask_files(spark, sf_dir))


@query(
    f"""WITH {SQL_SIDES} SELECT 'same names' AS sides, count(*) > 0 AS any_pair FROM raw SEMI JOIN masks USING (image_id)
UNION ALL SELECT 'other names', count(*) > 0 FROM raw SEMI JOIN (SELECT 'x' || image_id AS image_id FROM masks) USING (image_id)"""
)
def any_pairs(spark, sf_dir):
    """Whether any stem is on both sides, for masks as they are and under other names."""
    raw, masks = _raw_files(spark, sf_dir), _mask_files(spark, sf_dir)
    other = masks.withColumn("image_id", F.concat(F.lit("x"), "image_id"))
    found = [("same names", catalogue.has_pairs(raw, masks)), ("other names", catalogue.has_pairs(raw, other))]
    return spark.createDataFrame(found, "sides string, any_pair boolean")


@query(f"WITH {SQL_SIDES} SELECT image_id, max(path) AS path, count(*) AS n_files FROM raw GROUP BY 1")
def one_file_per_stem(spark, sf_dir):
    """The last path per stem."""
    return catalogue.one_file_per_stem(_raw_files(spark, sf_dir))


@query(f"WITH {SQL_SIDES} SELECT image_id, path FROM masks WHERE image_id IN (SELECT image_id FROM raw)")
def masks_with_raw(spark, sf_dir):
    """The semi-join behind "is there any pair"."""
    return catalogue.split_members(_mask_files(spark, sf_dir), _raw_files(spark, sf_dir))


@query(
    f"""WITH {SQL_SIDES},
meta AS (SELECT 'doc_' || (d + d % 3) AS image_id FROM lab),
keys AS (SELECT image_id FROM raw UNION SELECT image_id FROM masks UNION SELECT image_id FROM meta),
f AS (SELECT image_id, image_id IN (SELECT image_id FROM raw) AS in_raw,
             image_id IN (SELECT image_id FROM masks) AS in_mask,
             image_id IN (SELECT image_id FROM meta) AS in_meta FROM keys)
SELECT 'metadata_without_files' AS issue, image_id, in_raw, in_mask FROM f WHERE in_meta AND NOT (in_raw AND in_mask)
UNION ALL SELECT 'raw_without_mask', image_id, in_raw, in_mask FROM f WHERE in_raw AND NOT in_mask
UNION ALL SELECT 'mask_without_raw', image_id, in_raw, in_mask FROM f WHERE in_mask AND NOT in_raw"""
)
def orphans(spark, sf_dir):
    """Every mismatch between metadata, raw files and masks."""
    label = s.table(spark, sf_dir, "labels").select(
        (F.col("doc_id") + F.when(F.col("doc_id") % 11 == 0, 10_000_000).otherwise(0)).alias("d")
    )
    metadata = label.select(F.concat(F.lit("doc_"), (F.col("d") + F.col("d") % 3).cast("string")).alias("image_id"))
    return catalogue.consistency_issues(_raw_files(spark, sf_dir), _mask_files(spark, sf_dir), metadata)


@query(
    """WITH part_of AS (SELECT p_partkey FROM part),
big AS (SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem)
SELECT l_partkey AS image_key, l_orderkey, l_linenumber, l_quantity, p_name
FROM big JOIN part ON p_partkey = l_partkey"""
)
def salted_pairing(spark, sf_dir):
    """J1 on a large table: rows of hot keys are spread by salt."""
    from tilewright.operators.skew import salted_join

    facts = s.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("image_key"), "l_orderkey", "l_linenumber", "l_quantity"
    )
    lookup = s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_key"), "p_name")
    return salted_join(facts, lookup, "image_key")


def _documents_split(spark, sf_dir):
    rows = s.table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    return rows.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("image_id"))


@query(
    f"""WITH {SQL_PAIRS}
SELECT * FROM pairs WHERE image_id IN (SELECT 'doc_' || doc_id FROM documents WHERE lang = 'en')"""
)
def split_members(spark, sf_dir):
    """Pairs of one split."""
    pairs = catalogue.pair_files(_raw_files(spark, sf_dir), _mask_files(spark, sf_dir))
    return catalogue.split_members(pairs, _documents_split(spark, sf_dir))


@query(
    f"""WITH {SQL_SIDES}, names AS (SELECT 'doc_' || doc_id AS image_id FROM documents WHERE lang = 'en')
SELECT image_id, image_id NOT IN (SELECT image_id FROM raw) AS missing_raw,
       image_id NOT IN (SELECT image_id FROM masks) AS missing_mask
FROM names WHERE image_id NOT IN (SELECT image_id FROM raw) OR image_id NOT IN (SELECT image_id FROM masks)"""
)
def split_missing(spark, sf_dir):
    """Listed names that lack a file."""
    return catalogue.missing_members(
        _documents_split(spark, sf_dir), _raw_files(spark, sf_dir), _mask_files(spark, sf_dir)
    )


# --- metadata merges --------------------------------------------------------------------------


@query(
    f"""WITH {SQL_PART_FILES},
listed AS (SELECT DISTINCT stem AS image_id, '10x' AS m FROM stems WHERE p_partkey % 4 = 0)
SELECT name, coalesce(m, {s.sql_magnification('stem')}) AS magnification
FROM stems LEFT JOIN listed ON listed.image_id = stem"""
)
def resolved_magnification(spark, sf_dir):
    """The table wins over the file name."""
    files = part_files(spark, sf_dir)
    names = files.select(naming.base_name(F.col("path")).alias("name"))
    listed = (
        files.filter(F.col("p_partkey") % 4 == 0)
        .select(naming.stem(F.col("path")).alias("image_id"), F.lit("10x").alias("magnification"))
        .distinct()
    )
    return catalogue.resolve_magnification(names, listed)


def _doc_image(df):
    return F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), s.suffix(F.col("doc_id")), F.lit(".png"))


def _existing(spark, sf_dir):
    docs = s.table(spark, sf_dir, "documents")
    return docs.filter("doc_id % 3 <> 0").select(
        _doc_image(docs).alias("image"),
        F.lit("10x").alias("magnification"),
        F.col("lang").alias("condition"),
    )


def _arrived(spark, sf_dir):
    docs = s.table(spark, sf_dir, "documents")
    return catalogue.metadata_rows(docs.filter("doc_id % 5 <> 1").select(_doc_image(docs).alias("name")))


SQL_MERGE = f"""
doc AS (SELECT doc_id, lang, 'doc_' || doc_id || {s.sql_suffix('doc_id')} AS st FROM documents),
existing AS (SELECT st || '.png' AS image, '10x' AS magnification, lang AS condition FROM doc WHERE doc_id % 3 <> 0),
arrived AS (SELECT st || '.png' AS image,
                   CASE WHEN {s.sql_magnification('st')} = 'unknown' THEN '' ELSE {s.sql_magnification('st')} END AS magnification,
                   '' AS condition FROM doc WHERE doc_id % 5 <> 1)"""


@query(
    f"""WITH {SQL_MERGE}
SELECT *, FALSE AS added FROM existing
UNION ALL SELECT *, TRUE AS added FROM arrived WHERE image NOT IN (SELECT image FROM existing)"""
)
def metadata_merge(spark, sf_dir):
    """Existing rows win, new images are added."""
    return catalogue.merge_metadata(_existing(spark, sf_dir), _arrived(spark, sf_dir))


@query(f"WITH {SQL_MERGE} SELECT image FROM existing WHERE image NOT IN (SELECT image FROM arrived)")
def stale_rows(spark, sf_dir):
    """Rows whose image is gone."""
    return catalogue.stale_rows(_existing(spark, sf_dir), _arrived(spark, sf_dir))


@query(
    f"""WITH {SQL_MERGE},
merged AS (SELECT *, FALSE AS added FROM existing
           UNION ALL SELECT *, TRUE FROM arrived WHERE image NOT IN (SELECT image FROM existing))
SELECT count(*) AS rows, count(*) FILTER (added) AS added,
       count(*) FILTER (added AND magnification = '') AS need_magnification FROM merged"""
)
def merge_summary(spark, sf_dir):
    """A4: what a merge wrote."""
    return catalogue.run_summary(
        catalogue.merge_metadata(_existing(spark, sf_dir), _arrived(spark, sf_dir))
    )


# --- splits -----------------------------------------------------------------------------------


def _doc_metadata(spark, sf_dir):
    """Strata (lang, source): small joint groups, so magnification alone is used."""
    return s.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("image_id"),
        F.col("lang").alias("magnification"),
        F.col("source").alias("condition"),
    )


def _customer_metadata(spark, sf_dir):
    """Strata (suffix, segment) with blanks: every joint group is large enough."""
    key = F.col("c_custkey")
    return s.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c_"), key.cast("string")).alias("image_id"),
        F.when(key % 3 == 0, "4x").when(key % 3 == 1, "10x").otherwise("unknown").alias("magnification"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("  "))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit(None))
        .otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("condition"),
    )


def _sql_split(meta: str) -> str:
    """Stratified split in SQL over ``meta(image_id, magnification, condition)``."""
    return f"""{meta},
m AS (SELECT image_id, magnification, condition,
             coalesce(nullif(trim(condition), ''), 'unknown') AS cond FROM meta),
sg AS (SELECT magnification, cond, count(*) AS n,
             bool_or(coalesce(trim(condition), '') <> '') AS named FROM m GROUP BY 1, 2),
e AS (SELECT bool_and(n >= 3 AND round_even(n * 7e-1, 0) >= 1 AND round_even(n * 15e-2, 0) >= 1
             AND n - round_even(n * 7e-1, 0) - round_even(n * 15e-2, 0) >= 1) AND bool_or(named) AS joint FROM sg),
st AS (SELECT m.*, CASE WHEN joint THEN magnification || '|' || cond ELSE magnification END AS stratum FROM m, e),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || image_id), image_id) AS rn,
             count(*) OVER (PARTITION BY stratum) AS group_size FROM st),
assigned AS (SELECT image_id, magnification, condition, cond, stratum, rn, group_size,
       CASE WHEN rn <= round_even(group_size * 7e-1, 0) THEN 'train'
            WHEN rn <= round_even(group_size * 7e-1, 0) + round_even(group_size * 15e-2, 0) THEN 'val'
            ELSE 'test' END AS split FROM r)"""


SQL_DOC_META = "meta AS (SELECT 'doc_' || doc_id AS image_id, lang AS magnification, source AS condition FROM documents)"
SQL_CUSTOMER_META = """meta AS (SELECT 'c_' || c_custkey AS image_id,
  CASE c_custkey % 3 WHEN 0 THEN '4x' WHEN 1 THEN '10x' ELSE 'unknown' END AS magnification,
  CASE c_mktsegment WHEN 'BUILDING' THEN '  ' WHEN 'MACHINERY' THEN NULL ELSE ' ' || c_mktsegment END AS condition
  FROM customer)"""

SPLIT_COLUMNS = ("image_id", "stratum", "rn", "group_size", "split")


@query(
    f"""WITH {_sql_split("meta AS (SELECT 'synth_' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END || CASE p_partkey % 2 WHEN 0 THEN '_4x' ELSE '_10x' END AS image_id, CASE p_partkey % 2 WHEN 0 THEN '4x' ELSE '10x' END AS magnification, '' AS condition FROM part)")}
SELECT image_id, split FROM assigned"""
)
def synthetic_split_members(spark, sf_dir):
    """Split of synthetic pictures, one per row of a table, within each magnification."""
    return synthetic.splits_of(synthetic.named(s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"))))


@query(f"WITH {_sql_split(SQL_DOC_META)} SELECT {', '.join(SPLIT_COLUMNS)} FROM assigned")
def strat_split(spark, sf_dir):
    """Falls back to one stratum per magnification."""
    return splits.assign_splits(_doc_metadata(spark, sf_dir)).select(*SPLIT_COLUMNS)


@query(f"WITH {_sql_split(SQL_CUSTOMER_META)} SELECT {', '.join(SPLIT_COLUMNS)} FROM assigned")
def strat_split_joint(spark, sf_dir):
    """Joint strata of magnification and condition."""
    return splits.assign_splits(_customer_metadata(spark, sf_dir)).select(*SPLIT_COLUMNS)


@query(
    f"""WITH {_sql_split(SQL_CUSTOMER_META)}
SELECT magnification, cond AS condition, n, CAST(round_even(n * 7e-1, 0) AS BIGINT) AS n_train,
       CAST(round_even(n * 15e-2, 0) AS BIGINT) AS n_val,
       CAST(n - round_even(n * 7e-1, 0) - round_even(n * 15e-2, 0) AS BIGINT) AS n_test,
       n >= 3 AND round_even(n * 7e-1, 0) >= 1 AND round_even(n * 15e-2, 0) >= 1
         AND n - round_even(n * 7e-1, 0) - round_even(n * 15e-2, 0) >= 1 AS fills_all
FROM sg"""
)
def strata(spark, sf_dir):
    """Joint strata and whether they fill all splits."""
    return splits.strata_sizes(_customer_metadata(spark, sf_dir), 0.7, 0.15).drop("named")


@query(
    f"""WITH {_sql_split(SQL_CUSTOMER_META)}
SELECT split, magnification, cond AS condition, count(*) AS n FROM assigned
GROUP BY GROUPING SETS ((split), (split, magnification), (split, cond))"""
)
def split_summary(spark, sf_dir):
    """A5: sizes per split, magnification and condition."""
    return splits.split_summary(splits.assign_splits(_customer_metadata(spark, sf_dir)))


@query(
    """WITH lists AS (SELECT lang AS split, source AS image_id FROM documents
                     UNION ALL SELECT 'labels', 'src' || (doc_id % 40) FROM labels)
SELECT image_id, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM lists
GROUP BY 1 HAVING count(DISTINCT split) > 1"""
)
def split_leak(spark, sf_dir):
    """Names in several lists."""
    docs = s.table(spark, sf_dir, "documents")
    labels = s.table(spark, sf_dir, "labels")
    lists = docs.select(F.col("lang").alias("split"), F.col("source").alias("image_id")).unionByName(
        labels.select(
            F.lit("labels").alias("split"),
            F.concat(F.lit("src"), (F.col("doc_id") % 40).cast("string")).alias("image_id"),
        )
    )
    return splits.split_leaks(lists)


@query(
    """SELECT lang AS split, trim(source || CASE doc_id % 2 WHEN 0 THEN ' ' ELSE '' END) AS image_id,
       min(doc_id) AS pos FROM documents GROUP BY 1, 2"""
)
def dedupe_keep_first(spark, sf_dir):
    """First position per name of a list."""
    lists = s.table(spark, sf_dir, "documents").select(
        F.col("lang").alias("split"),
        F.concat("source", F.when(F.col("doc_id") % 2 == 0, " ").otherwise("")).alias("image_id"),
        F.col("doc_id").alias("pos"),
    )
    return splits.keep_first(lists)


# --- quality control --------------------------------------------------------------------------


def _customer_labels(spark, sf_dir):
    """Mask pixels of a customer: one per order, class from the priority digit (4 is invalid)."""
    return s.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("image_key"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"),
    )


def _label_counts(spark, sf_dir):
    return _customer_labels(spark, sf_dir).groupBy("image_key", "label").agg(F.count(F.lit(1)).alias("n"))


SQL_LABELS = """
lab AS (SELECT o_custkey AS image_key, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS label FROM orders),
wide AS (SELECT image_key, count(*) FILTER (label = 0) AS class_0, count(*) FILTER (label = 1) AS class_1,
                count(*) FILTER (label = 2) AS class_2, count(*) FILTER (label = 3) AS class_3,
                count(*) FILTER (label BETWEEN 0 AND 3) AS total_pixels FROM lab GROUP BY 1)"""


@query(f"WITH {SQL_LABELS} SELECT * FROM wide")
def class_counts(spark, sf_dir):
    """A1: zero-filled class counts per mask."""
    return annotation.class_counts(_label_counts(spark, sf_dir), "image_key")


@query(
    f"""WITH {SQL_LABELS},
t AS (SELECT CASE WHEN GROUPING(image_key) = 1 THEN 'all' ELSE 'image' END AS grain, image_key,
             CAST(sum(total_pixels) AS BIGINT) AS total_pixels, CAST(sum(class_0) AS BIGINT) AS c0,
             CAST(sum(class_1) AS BIGINT) AS c1, CAST(sum(class_2) AS BIGINT) AS c2,
             CAST(sum(class_3) AS BIGINT) AS c3 FROM wide GROUP BY GROUPING SETS ((image_key), ())),
l AS (SELECT grain, image_key, total_pixels, 0 AS label, c0 AS n FROM t UNION ALL
      SELECT grain, image_key, total_pixels, 1, c1 FROM t UNION ALL
      SELECT grain, image_key, total_pixels, 2, c2 FROM t UNION ALL
      SELECT grain, image_key, total_pixels, 3, c3 FROM t)
SELECT *, CASE WHEN total_pixels = 0 THEN 0e0 ELSE 1e2 * n / total_pixels END AS pct FROM l"""
)
def class_distribution(spark, sf_dir):
    """A2: shares per image and over all images."""
    wide = annotation.class_counts(_label_counts(spark, sf_dir), "image_key")
    return annotation.class_distribution(wide, "image_key")


@query(
    f"""WITH {SQL_LABELS}
SELECT image_key, coalesce(string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR))
       FILTER (label NOT BETWEEN 0 AND 3), '') AS invalid FROM lab GROUP BY 1"""
)
def invalid_labels(spark, sf_dir):
    """Labels outside the valid set."""
    found = annotation.invalid_labels(_label_counts(spark, sf_dir), "image_key")
    return found.select("image_key", F.array_join(F.col("invalid").cast("array<string>"), ",").alias("invalid"))


def _checked_pairs(spark, sf_dir):
    key = F.col("c_custkey")
    pairs = s.table(spark, sf_dir, "customer").select(
        key.alias("image_key"),
        (100 + F.col("c_nationkey") % 2).alias("raw_height"),
        F.lit(128).alias("raw_width"),
        (100 + key % 2).cast("int").alias("mask_height"),
        F.lit(128).alias("mask_width"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "float32").otherwise("uint8").alias("mask_dtype"),
        F.when(key % 17 == 0, "cut short").alias("raw_error"),
        F.when(key % 19 == 0, "no pixels").alias("mask_error"),
    )
    counts = annotation.invalid_labels(_label_counts(spark, sf_dir), "image_key")
    return pairs.join(counts, "image_key", "left").withColumn(
        "invalid", F.coalesce("invalid", F.array().cast("array<int>"))
    )


SQL_VIOLATIONS = f"""{SQL_LABELS},
bad AS (SELECT image_key, string_agg(DISTINCT CAST(label AS VARCHAR), ', ' ORDER BY CAST(label AS VARCHAR))
               FILTER (label NOT BETWEEN 0 AND 3) AS invalid FROM lab GROUP BY 1),
p AS (SELECT c_custkey AS image_key, 100 + c_nationkey % 2 AS rh, 100 + c_custkey % 2 AS mh,
             CASE WHEN c_mktsegment = 'MACHINERY' THEN 'float32' ELSE 'uint8' END AS dt,
             c_custkey % 17 = 0 AS raw_bad, c_custkey % 19 = 0 AS mask_bad FROM customer),
v AS (SELECT p.image_key, CASE WHEN raw_bad THEN 'raw read error: cut short'
       WHEN mask_bad THEN 'mask read error: no pixels'
       ELSE concat_ws('; ',
         CASE WHEN rh <> mh THEN 'shape mismatch: raw (' || rh || ', 128) vs mask (' || mh || ', 128)' END,
         CASE WHEN dt <> 'uint8' THEN 'mask dtype ' || dt || ' != uint8' END,
         CASE WHEN invalid IS NOT NULL THEN 'invalid mask values [' || invalid || ']' END) END AS violations
      FROM p LEFT JOIN bad USING (image_key))"""


@query(f"WITH {SQL_VIOLATIONS} SELECT * FROM v")
def qc_violations(spark, sf_dir):
    """Messages per pair, joined as in the report."""
    checked = annotation.violations(_checked_pairs(spark, sf_dir))
    return checked.select("image_key", F.array_join("violations", "; ").alias("violations"))


@query(
    f"""WITH {SQL_VIOLATIONS} SELECT count(*) AS n_pairs, count(*) FILTER (violations <> '') AS n_failed,
count(*) FILTER (violations <> '') = 0 AS passed FROM v"""
)
def qc_verdict(spark, sf_dir):
    """A3: how many pairs failed."""
    return annotation.verdict(annotation.violations(_checked_pairs(spark, sf_dir)))


# --- windows over whole tables ----------------------------------------------------------------

SQL_OVERLAY_SAMPLES = """
x AS (SELECT 's_' || s_suppkey || '_' || s_nationkey AS name,
             CASE s_suppkey % 7 WHEN 0 THEN '4x' WHEN 1 THEN '10x' WHEN 2 THEN '10x' WHEN 3 THEN '20x' ELSE 'unknown' END
             AS magnification FROM supplier)"""


@query(
    f"""WITH {SQL_OVERLAY_SAMPLES},
r AS (SELECT *, row_number() OVER (PARTITION BY magnification ORDER BY name) AS k FROM x
      WHERE magnification IN ('4x', '10x', 'unknown')),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN magnification <> 'unknown' AND k <= 3 THEN 0 ELSE 1 END, name)
      AS place FROM r)
SELECT name, magnification FROM o WHERE place <= 7"""
)
def overlay_selection(spark, sf_dir):
    """Seven names, half 4x and half 10x, filled up by name."""
    key = F.col("s_suppkey")
    samples = s.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s_"), key.cast("string"), F.lit("_"), F.col("s_nationkey").cast("string")).alias("name"),
        F.when(key % 7 == 0, "4x").when(key % 7 <= 2, "10x").when(key % 7 == 3, "20x").otherwise("unknown").alias("magnification"),
    )
    return overlays.select_overlays(samples, 7)


SQL_EPOCHS = """
e AS (SELECT user_id, value AS score,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events),
b AS (SELECT *, max(score) OVER (PARTITION BY user_id ORDER BY epoch
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, score > coalesce(before, -1e0) AS improved FROM b),
l AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_improved FROM i),
st AS (SELECT user_id, min(epoch) AS stop_epoch FROM l WHERE epoch - coalesce(last_improved, 0) >= 5 GROUP BY 1),
k AS (SELECT l.*, stop_epoch FROM l LEFT JOIN st USING (user_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch)"""


def _epochs(spark, sf_dir):
    from tilewright.operators.ordering import ordered_rank

    events = s.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("value").alias("score"))
    return ordered_rank(events, ["user_id"], ["ts", "event_id"], rank="epoch").select("user_id", "epoch", "score")


@query(f"WITH {SQL_EPOCHS} SELECT user_id, epoch, score, improved, last_improved, stop_epoch FROM k")
def early_stop(spark, sf_dir):
    """Improvements and the stop per run."""
    return training_log.early_stop(_epochs(spark, sf_dir), ["user_id"], patience=5)


@query(
    f"""WITH {SQL_EPOCHS} SELECT user_id, max(epoch) AS epochs_run, max(last_improved) AS best_epoch,
max(CASE WHEN improved THEN score END) AS best_score, max(stop_epoch) AS stop_epoch FROM k GROUP BY 1"""
)
def run_outcome(spark, sf_dir):
    """Best and last epoch per run."""
    stopped = training_log.early_stop(_epochs(spark, sf_dir), ["user_id"], patience=5)
    return training_log.run_outcome(stopped, ["user_id"])


def _sql_batches(order: str) -> str:
    return f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, (rn - 1) // 64 AS batch_id, CAST((rn - 1) % 64 AS INT) AS slot FROM r WHERE rn <= (n // 64) * 64"""


@query(_sql_batches("md5('7:' || o_orderkey), o_orderkey"))
def batches_shuffled(spark, sf_dir):
    """Batches of 64 in hash order."""
    return batches.assign_batches(s.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 64, seed=7)


@query(_sql_batches("o_orderkey"))
def batches_ordered(spark, sf_dir):
    """Batches of 64 in key order."""
    return batches.assign_batches(s.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 64)


# --- artifacts --------------------------------------------------------------------------------


@query(
    """WITH a AS (SELECT 'cfg-' || event_type AS config, ts AS modified,
  '/runs/cfg-' || event_type || '_' || (20240101 + event_id // 1000000) || '_' || lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') ||
  '/checkpoints/best_checkpoint.msgpack' AS path FROM events)
SELECT config, arg_max(path, (modified, path)) AS path, max(modified) AS modified, count(*) AS n_runs FROM a GROUP BY 1"""
)
def newest_artifact(spark, sf_dir):
    """The newest artifact of every config."""
    config = F.concat(F.lit("cfg-"), "event_type")
    # A run's stamp is a date and six digits; larger numbers go on with the next date.
    stamp = F.format_string("%08d_%06d", 20240101 + F.expr("event_id div 1000000"), F.col("event_id") % 1_000_000)
    listing = s.table(spark, sf_dir, "events").select(
        F.concat(F.lit("/runs/"), config, F.lit("_"), stamp, F.lit("/" + runs.BEST_ARTIFACT)).alias("path"),
        F.col("ts").alias("modified"),
    )
    return runs.newest_per_config(listing)
