"""Registered queries over augmented patches, one per step that draws pixels, with the SQL that replays it."""

from __future__ import annotations

from typing import Any

import numpy as np

from tilewright.functions.draws import COUNTER_STEP, MIX, STREAM_STEP
from tilewright.operators import augment
from tilewright.plans import standins as s
from tilewright.plans.registry_pixels import _picture_patches, patch_sums

QUERIES = {}
ORACLES = {}
NOTHING = {
    f"{step}_probability": 0.0 for step in ("flip", "rotate90", "elastic", "scale", "blur", "noise", "brightness_contrast")
}
SEED = 5
#: The displacement field of the 8 x 8 pictures: strong and short, so that it moves pixels.
ALPHA, SIGMA = 3.0, 1.0


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return keep


def _augmented(spark, sf_dir, hook=None, **spec):
    table = augment.augment_patches(_picture_patches(spark, sf_dir), augment.AugmentSpec(**{**NOTHING, **spec}), seed=SEED, hook=hook)
    return patch_sums(table)


def _key(step: str) -> str:
    return f"md5('{SEED}:{step}:' || image_id || ':1')"


def sql_words(name: str, source: str, stream: int) -> str:
    """CTE ``<name>``: the uniform number ``u`` of every pixel of ``source(image_id, y, x, seed)``."""
    mixed = "((xor({0}, {0} >> 16) * " + str(MIX) + ") & 4294967295)"
    return f"""
{name}_a AS (SELECT image_id, y, x, ((xor(seed, {stream * STREAM_STEP & 0xFFFFFFFF}) + (8 * y + x) * {COUNTER_STEP}) & 4294967295) AS w FROM {source}),
{name}_b AS (SELECT image_id, y, x, {mixed.format('w')} AS w FROM {name}_a),
{name}_c AS (SELECT image_id, y, x, {mixed.format('w')} AS w FROM {name}_b),
{name} AS (SELECT image_id, y, x, (CAST(xor(w, w >> 16) AS DOUBLE) + 5e-1) / 4294967296e0 AS u FROM {name}_c)"""


def _mirror(i: str) -> str:
    return f"CASE WHEN (({i}) % 14 + 14) % 14 < 8 THEN (({i}) % 14 + 14) % 14 ELSE 14 - (({i}) % 14 + 14) % 14 END"


SQL_SUMS = """SELECT image_id, 1 AS patch_id, CAST(sum(CAST(round_even(least(greatest(v, 0e0), 255e0), 0) AS BIGINT) * (8 * y + x + 1)) AS BIGINT) AS image_sum,
CAST(sum(m * (8 * y + x + 1)) AS BIGINT) AS mask_sum FROM o GROUP BY 1"""
SQL_MASKED = "pic AS (SELECT image_id, y, x, CAST(v AS DOUBLE) AS v, CAST(v > 150 AS INT) AS m FROM vec_px)"


def sql_sampled(place: str) -> str:
    """CTE ``o``: ``pic`` read at the real places ``ay, ax`` of ``place(image_id, y, x, ay, ax)``."""
    tap = "SELECT spot.image_id, spot.y, spot.x, {w} * pic.v AS part FROM spot JOIN pic ON pic.image_id = spot.image_id AND pic.y = {r} AND pic.x = {c}"
    taps = " UNION ALL ".join(
        tap.format(w=f"({'py' if j else '(1 - py)'} * {'px' if i else '(1 - px)'})", r=f"y{j}", c=f"x{i}") for j in (0, 1) for i in (0, 1)
    )
    return f"""
low AS (SELECT *, CAST(floor(ay) AS INT) AS ly, CAST(floor(ax) AS INT) AS lx FROM {place}),
spot AS (SELECT image_id, y, x, ay - ly AS py, ax - lx AS px, {_mirror('ly')} AS y0, {_mirror('ly + 1')} AS y1, {_mirror('lx')} AS x0, {_mirror('lx + 1')} AS x1,
              {_mirror('CAST(round_even(ay, 0) AS INT)')} AS ny, {_mirror('CAST(round_even(ax, 0) AS INT)')} AS nx FROM low),
blend AS (SELECT image_id, y, x, sum(part) AS v FROM ({taps}) GROUP BY ALL),
o AS (SELECT blend.image_id, blend.y, blend.x, blend.v, pic.m FROM blend JOIN spot USING (image_id, y, x) JOIN pic ON pic.image_id = spot.image_id AND pic.y = ny AND pic.x = nx)"""


def sql_smoothed(name: str, source: str, value: str, taps: str) -> str:
    """CTE ``<name>``: ``value`` of ``source`` smoothed along both axes with ``taps(image_id, k, w)``."""
    return f"""
{name}_x AS (SELECT a.image_id, a.y, a.x, sum(t.w * b.{value}) AS {value} FROM {source} a JOIN {taps} t ON t.image_id = a.image_id
  JOIN {source} b ON b.image_id = a.image_id AND b.y = a.y AND b.x = {_mirror('a.x + t.k')} GROUP BY ALL),
{name} AS (SELECT a.image_id, a.y, a.x, sum(t.w * b.{value}) AS {value} FROM {name}_x a JOIN {taps} t ON t.image_id = a.image_id
  JOIN {name}_x b ON b.image_id = a.image_id AND b.x = a.x AND b.y = {_mirror('a.y + t.k')} GROUP BY ALL)"""


REACH = max(1, int(3 * SIGMA))


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, {SQL_MASKED},
seeded AS (SELECT image_id, y, x, {s.sql_draw(_key('elastic'), 1)} AS seed FROM pic), {sql_words('uy', 'seeded', 0)}, {sql_words('ux', 'seeded', 1)},
f AS (SELECT image_id, y, x, 2 * uy.u - 1 AS dy, 2 * ux.u - 1 AS dx FROM uy JOIN ux USING (image_id, y, x)),
bell AS (SELECT k, exp(-5e-1 * (k / {SIGMA}) ** 2) AS w FROM range(-{REACH}, {REACH + 1}) AS r(k)),
taps AS (SELECT image_id, k, w / (SELECT sum(w) FROM bell) AS w FROM bell, (SELECT DISTINCT image_id FROM pic)),
{sql_smoothed('sy', 'f', 'dy', 'taps')}, {sql_smoothed('sx', 'f', 'dx', 'taps')},
place AS (SELECT image_id, y, x, y + {ALPHA} * dy AS ay, x + {ALPHA} * dx AS ax FROM sy JOIN sx USING (image_id, y, x)), {sql_sampled('place')} {SQL_SUMS}"""
)
def elastic_patches(spark, sf_dir):
    """U4: image and mask of every picture moved by a smoothed field of drawn shifts."""
    return _augmented(spark, sf_dir, elastic_probability=1.0, elastic_alpha=ALPHA, elastic_sigma=SIGMA)


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, {SQL_MASKED},
drawn AS (SELECT image_id, y, x, 5e-1 + {s.sql_uniform(_key('zoom'), 1)} * 15e-1 AS z FROM pic),
place AS (SELECT image_id, y, x, 35e-1 + (y - 35e-1) / z AS ay, 35e-1 + (x - 35e-1) / z AS ax FROM drawn), {sql_sampled('place')} {SQL_SUMS}"""
)
def zoom_patches(spark, sf_dir):
    """Every picture zoomed about its centre by a drawn factor."""
    return _augmented(spark, sf_dir, scale_probability=1.0)


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, {SQL_MASKED},
drawn AS (SELECT image_id, {s.sql_draw(_key('blur'), 1)} % 3 + 1 AS reach, 1e-1 + {s.sql_uniform(_key('blur'), 2)} * (2e0 - 1e-1) AS sigma FROM (SELECT DISTINCT image_id FROM pic)),
bell AS (SELECT image_id, k, exp(-5e-1 * (k / sigma) ** 2) AS w FROM drawn JOIN range(-3, 4) AS r(k) ON abs(k) <= reach),
taps AS (SELECT image_id, k, w / sum(w) OVER (PARTITION BY image_id) AS w FROM bell),
{sql_smoothed('soft', 'pic', 'v', 'taps')}, o AS (SELECT image_id, y, x, soft.v, m FROM soft JOIN pic USING (image_id, y, x)) {SQL_SUMS}"""
)
def blur_patches(spark, sf_dir):
    """Every picture blurred with a drawn size and width; masks stay."""
    return _augmented(spark, sf_dir, blur_probability=1.0)


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, {SQL_MASKED},
seeded AS (SELECT image_id, y, x, {s.sql_draw(_key('noise'), 2)} AS seed FROM pic), {sql_words('ua', 'seeded', 0)}, {sql_words('ub', 'seeded', 1)},
o AS (SELECT image_id, y, x, m, v + (1e-2 + {s.sql_uniform(_key('noise'), 1)} * (5e-2 - 1e-2)) * 255e0 * sqrt(-2e0 * ln(ua.u)) * cos(2e0 * pi() * ub.u) AS v
      FROM pic JOIN ua USING (image_id, y, x) JOIN ub USING (image_id, y, x)) {SQL_SUMS}"""
)
def noise_patches(spark, sf_dir):
    """Normal noise of a drawn strength on every picture; masks stay."""
    return _augmented(spark, sf_dir, noise_probability=1.0)


def inverted(image: np.ndarray, mask: np.ndarray, row: dict[str, Any]) -> tuple[np.ndarray, np.ndarray]:
    """A user's hook: negative picture, mask turned over, both the other way round for wide ids."""
    image, mask = 255.0 - image, 1 - mask
    return (image.T, mask.T) if len(row["image_id"]) % 2 else (image, mask)


@query(
    f"""WITH {s.SQL_VECTOR_PIXELS}, {SQL_MASKED},
o AS (SELECT image_id, CASE WHEN length(image_id) % 2 = 1 THEN x ELSE y END AS y, CASE WHEN length(image_id) % 2 = 1 THEN y ELSE x END AS x, 255e0 - v AS v, 1 - m AS m FROM pic) {SQL_SUMS}"""
)
def hooked_patches(spark, sf_dir):
    """a function of the user's own on image, mask and row of every patch."""
    return _augmented(spark, sf_dir, hook=inverted)
