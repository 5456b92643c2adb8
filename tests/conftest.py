from __future__ import annotations

import os
import sys

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Workers import the package and the functions defined in the tests.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])

from tilewright.functions.blocks import IMAGE_SCHEMA, packed  # noqa: E402
from tilewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus="4")
    yield session
    session.stop()


@pytest.fixture
def image_rows(spark):
    """Image rows from ``{image_id: array}``."""

    def make(arrays: dict[str, np.ndarray]):
        rows = [{"image_id": k, **packed(v)} for k, v in arrays.items()]
        return spark.createDataFrame([tuple(r[n] for n in IMAGE_SCHEMA.names) for r in rows], IMAGE_SCHEMA)

    return make


@pytest.fixture
def arrays():
    """``{image_id: array}`` from image rows."""

    def read(df):
        out = {}
        for r in df.collect():
            flat = np.frombuffer(bytes(r["data"]), dtype=r["dtype"])
            shape = (r["height"], r["width"]) + ((r["channels"],) if r["channels"] > 1 else ())
            out[r["image_id"]] = flat.reshape(shape)
        return out

    return read


@pytest.fixture
def pasted():
    """``{image_id: array}`` from block rows that cover each picture exactly once."""

    def read(df):
        by_image = {}
        for r in df.collect():
            by_image.setdefault(r["image_id"], []).append(r)
        out = {}
        for name, rows in by_image.items():
            h = max(r["y0"] + r["height"] for r in rows)
            w = max(r["x0"] + r["width"] for r in rows)
            c = rows[0]["channels"]
            canvas = np.zeros((h, w) if c == 1 else (h, w, c), dtype=rows[0]["dtype"])
            seen = np.zeros((h, w), dtype=int)
            for r in rows:
                block = np.frombuffer(bytes(r["data"]), dtype=r["dtype"])
                block = block.reshape((r["height"], r["width"]) + (() if c == 1 else (c,)))
                at = np.s_[r["y0"] : r["y0"] + r["height"], r["x0"] : r["x0"] + r["width"]]
                canvas[at] = block
                seen[at] += 1
            assert (seen == 1).all(), name
            out[name] = canvas
        return out

    return read
