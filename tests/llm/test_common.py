from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import common, textscan


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    part, n = rng.integers(0, 7, 500), rng.integers(0, 4, 500)
    a, b = rng.integers(0, 1 << 60, 500).astype("u8"), rng.random(500).astype("f4")
    c = np.arange(n.sum(), dtype="u4")
    (batch,) = common.split(part, 7, a, b, n.astype("u1"), detail=(np.repeat(part, n), c))
    for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        x, y, m, z = common.unpacked([blob, blob], ("u8", "f4", "u1"), ("u4",))
        here = part == k
        assert (x == np.tile(a[here], 2)).all() and (y == np.tile(b[here], 2)).all() and (m == np.tile(n[here], 2)).all()
        assert (z == np.tile(c[np.repeat(here, n)], 2)).all()


def test_exchange_and_written(spark):
    def mapper(batches):
        for batch in batches:
            v = batch.column(0).to_numpy()
            yield from common.split(v % 3, 3, v)

    def reducer(blobs):
        (v,) = common.unpacked(blobs, ("i8",))
        return pa.table({"n": [len(v)], "s": [int(v.sum())]})

    got = common.written(common.exchange(spark.range(100), mapper, reducer, "n long, s long"))
    assert sorted(map(tuple, got.collect())) == sorted((len(r), sum(r)) for r in (range(k, 100, 3) for k in range(3)))


def test_scratch_tables_go_and_kept_ones_stay(spark):
    import os

    with common.scratch(spark):
        inner = common.written(spark.range(5))
        out = common.kept(inner.withColumn("x", inner["id"] * 2))
    assert out.count() == 5 and not os.path.exists(inner._tessera_path.removeprefix("file://"))
    common.discard(out)
    assert not os.path.exists(out._tessera_path.removeprefix("file://"))


def test_key_filter(spark):
    keys = spark.range(0, 3000, 3).select("id", (F.col("id") * 7).alias("b"))
    got = common.KeyFilter.of(keys)
    a = np.arange(3000)
    held = got.holds(a, a * 7)
    assert held[::3].all() and held.sum() < 1300
    assert not common.KeyFilter.of(keys.limit(0)).holds(a, a).any()


def test_unused_names(spark):
    df = spark.range(1).select(F.lit(1).alias("Text_Key"), F.lit(2).alias("text_key_"))
    assert common.unused(df, "text_key", "other", "other") == ["text_key__", "other", "other_"]


def test_hashes_do_not_depend_on_runs(monkeypatch):
    """Texts, words and spans that are longer than a run of bytes are hashed as in one run."""
    rng = np.random.default_rng(3)
    texts = [" ".join("w" * int(n) + str(n) for n in rng.integers(1, 30, 400)), "x" * 5000, "a b"]
    h = rng.integers(0, 1 << 60, 3000).astype("u8")
    lo = np.sort(rng.integers(0, 2900, 50))
    hi = lo + rng.integers(1, 100, 50)

    def all_of():
        words = [w.hash[w.first[t] : w.first[t + 1]].tolist() for _, _, w in textscan.words(pa.array(texts)) for t in range(w.n)]
        return words, textscan.rolling(h, 20).tolist(), textscan.spans_hash(h, lo, hi).tolist()

    whole = all_of()
    monkeypatch.setattr(textscan, "CHUNK_BYTES", 256)
    monkeypatch.setattr(textscan._Powers, "up", textscan._powers(textscan._P, 300))
    monkeypatch.setattr(textscan._Powers, "down", textscan._powers(textscan._P_INVERSE, 300))
    assert all_of() == whole


def test_words_against_plain_python():
    texts = ["The  cat, the CAT; ünï – 12x", "", "a", "end.", "end"]
    hashes = [h for _, _, w in textscan.words(pa.array(texts)) for h in (w.hash[w.first[t] : w.first[t + 1]].tolist() for t in range(w.n))]
    plain = [["the", "cat", "the", "cat", "ünï", "12x"], [], ["a"], ["end"], ["end"]]
    assert [len(h) for h in hashes] == [len(p) for p in plain]
    seen: dict = {}
    for h, p in zip(hashes, plain, strict=True):
        for x, y in zip(h, p, strict=True):
            assert seen.setdefault(y, x) == x
    assert len(set(seen.values())) == len(seen)
