"""The page reader against sqlite3, and on cut and damaged files."""

import os
import random
import sqlite3

import pytest

from patchweave.sources import sqlite_pages as S


def database(sizes, page=4096, extra=True):
    con = sqlite3.connect(":memory:")
    con.execute(f"PRAGMA page_size = {page}")
    if extra:
        con.execute("CREATE TABLE other (a TEXT, b REAL)")
        con.executemany("INSERT INTO other VALUES (?, ?)", [(str(i), i / 3) for i in range(300)])
    con.execute("CREATE TABLE 'Packages' (hnum INTEGER PRIMARY KEY AUTOINCREMENT, blob BLOB NOT NULL)")
    blobs = [os.urandom(n) for n in sizes]
    con.executemany("INSERT INTO Packages (blob) VALUES (?)", [(b,) for b in blobs])
    con.execute("CREATE INDEX i ON Packages (hnum)")
    con.commit()
    return con.serialize(), blobs


@pytest.mark.parametrize("page", [512, 1024, 4096, 65_536])
@pytest.mark.parametrize("sizes", [[], [0, 1, 10], [3_000] * 50, [100_000, 5, 70_000], list(range(0, 9_000, 37))])
def test_rows(page, sizes):
    data, blobs = database(sizes, page)
    assert S.table_column(data, "Packages", "blob") == blobs
    assert S.table_column(data, "other", "a") == [str(i).encode() for i in range(300)]
    assert S.table_column(data, "packages", "HNUM") == [None] * len(blobs)  # the key stands for it


def test_cut_and_damaged_files_never_give_fewer_rows():
    data, blobs = database([700] * 400 + [20_000] * 5, 1024)
    for n in (0, 10, 99, 511, 1024, len(data) // 2, len(data) - 1024, len(data) - 1):
        with pytest.raises(S.Damaged):
            S.table_column(data[:n], "Packages", "blob")
    with pytest.raises(S.Damaged):
        S.table_column(data, "Packages", "none")
    with pytest.raises(S.Damaged):
        S.table_column(data, "none", "blob")
    rng = random.Random(6)
    for _ in range(400):  # a wrong byte in the head of a page: refused, or all rows are there
        hurt = bytearray(data)
        at = rng.randrange(len(data) // 1024) * 1024 + rng.randrange(12)
        hurt[at] ^= 1 << rng.randrange(8)
        try:
            assert len(S.table_column(bytes(hurt), "Packages", "blob")) == len(blobs)
        except S.Damaged:
            pass
        except AssertionError:
            assert at % 1024 in (3, 4), at  # fewer cells than there were can't be told from rows deleted
