"""The stratified split looks for the last train row of a class only; numbering all rows is left for repeated ids."""

import hashlib
import math

import pytest

from tickweave.operators import prep as Z

CLASSES = [("a", 400), ("b", 37), (None, 11), ("c", 1)]
ROWS = [(y, 1000 * c + i) for c, (y, n) in enumerate(CLASSES) for i in range(n)]


def brute(rows, frac, seed):
    train = set()
    for y in {y for y, _ in rows}:
        ids = sorted((i for k, i in rows if k == y), key=lambda i: (int(hashlib.md5(f"{seed}-{i}".encode()).hexdigest()[:15], 16), i))
        train |= set(ids[: math.floor(len(ids) * frac)])
    return train


@pytest.mark.parametrize("frac", [0.0, 0.3, 0.7, 1.0])
def test_split_without_numbering_rows(spark, monkeypatch, frac):
    monkeypatch.setattr(Z, "index_rows", lambda *a, **k: pytest.fail("numbers every row"))
    df = spark.createDataFrame(ROWS, "y string, id long")
    got = Z.stratified_split(df, "y", "id", frac, seed=4)
    assert got.columns == ["y", "id", "is_train"]
    assert {r["id"] for r in got.filter("is_train").collect()} == brute(ROWS, frac, 4) and got.count() == len(ROWS)


def test_repeated_ids_keep_the_share(spark):
    df = spark.createDataFrame([("a", 5)] * 10 + [("b", i) for i in range(10)], "y string, id long")
    got = Z.stratified_split(df, "y", "id", 0.7)
    assert {r["y"]: r["count"] for r in got.filter("is_train").groupBy("y").count().collect()} == {"a": 7, "b": 7}
