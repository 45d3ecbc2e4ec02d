"""Archives as a data source: ranges, damage, size; feeds and images read from them, with counts of what is left out."""

import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest

from patchweave.operators import telemetry as T
from patchweave.sources import archives as A
from patchweave.sources import feeds, images
from tests.test_images import layer


def tar_of(path, files, mode="w"):
    with tarfile.open(path, mode) as t:
        for name, data in files:
            m = tarfile.TarInfo(name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))


FILES = [(f"d/{i}.json", os.urandom(i * 37) + b"a" * i) for i in range(40)]


@pytest.mark.parametrize("kind", ["zip", "stored", "tar", "tgz", "zst"])
def test_members(spark, tmp_path, kind):
    path = str(tmp_path / f"x.{kind}")
    if kind in ("zip", "stored"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if kind == "zip" else zipfile.ZIP_STORED) as z:
            z.mkdir("d")
            for n, d in FILES:
                z.writestr(n, d)
            z.writestr("other.txt", b"x")
    else:
        plain = str(tmp_path / "plain")
        tar_of(plain, [*FILES, ("other.txt", b"x")])
        if kind == "zst":
            zstandard = pytest.importorskip("zstandard")
            open(path, "wb").write(zstandard.ZstdCompressor().compress(open(plain, "rb").read()))
        else:
            open(path, "wb").write(open(plain, "rb").read() if kind == "tar" else gzip.compress(open(plain, "rb").read()))
    df = A.read_archive(spark, path, r"d/.+[.]json", partitionBytes=10_000, maxMemberBytes=1_400)
    got = {r.member: r for r in df.collect()}
    assert {n: len(d) for n, d in FILES} == {n: r.size for n, r in got.items()}
    for n, d in FILES:
        assert bytes(got[n].content or b"") == (d if len(d) <= 1_400 else b"") and (got[n].reason is None) == (len(d) <= 1_400)
    assert df.rdd.getNumPartitions() == 1 if kind in ("tgz", "zst") else df.rdd.getNumPartitions() > 3


def test_damaged_archives_are_rows_with_a_reason(spark, tmp_path):
    good = str(tmp_path / "a.zip")
    with zipfile.ZipFile(good, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok.json", b"1" * 500)
        z.writestr("bad.json", os.urandom(500))
    data = bytearray(open(good, "rb").read())
    at = data.rindex(b"bad.json", 0, data.index(b"PK\x01\x02")) + 30
    data[at : at + 4] = b"zzzz"
    open(good, "wb").write(data)
    open(tmp_path / "b.zip", "wb").write(data[:-40])
    open(tmp_path / "c.tar", "wb").write(b"junk" * 300)
    open(tmp_path / "d.tgz", "wb").write(gzip.compress(b"\0" * 9000 + b"x" * 9000)[:60])
    rows = {(os.path.basename(r.path), r.member): r.reason for r in A.read_archive(spark, str(tmp_path / "*")).collect()}
    assert rows["a.zip", "ok.json"] is None and rows["a.zip", "bad.json"] and rows["b.zip", None] and rows["c.tar", None]
    assert all(v for k, v in rows.items() if k[0] == "d.tgz")
    assert A.read_archive(spark, str(tmp_path / "none.zip")).first().reason


def test_an_archive_of_three_gigabytes(spark, tmp_path):
    """No row above a member's size; the file is sparse."""
    path, size, n = str(tmp_path / "big.tar"), 50 << 20, 62
    with open(path, "wb") as f:
        for i in range(n):
            m = tarfile.TarInfo(f"m{i}")
            m.size = size
            f.write(m.tobuf())
            f.seek(size, 1)
        f.write(b"\0" * 1024)
    assert os.path.getsize(path) > 3 << 30
    df = A.read_archive(spark, path)
    r = df.selectExpr("count(*) n", "max(length(content)) most", "count(reason) lost").first()
    assert (r.n, r.most, r.lost) == (n, size, 0)


RECORDS = [
    {"id": "GHSA-1", "modified": "2024-01-01T00:00:00Z", "affected": [{"package": {"name": "a", "ecosystem": "npm"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}]}]}, {"package": {"name": "a", "ecosystem": "npm"}, "ranges": [{"type": "GIT", "events": [{"introduced": "0"}]}]}]},
    {"id": "GHSA-2", "withdrawn": "2024-01-01T00:00:00Z"}, {"id": "MAL-1"}, {"id": "ALBA-1"}, {"summary": "no id"},
    {"id": "CGA-1", "affected": [{"package": {"name": n, "ecosystem": e}, "versions": ["1"]} for n, e in (("w", "Wolfi"), ("c", "Chainguard:rolling"), ("u", "Ubuntu:Pro:22.04:LTS"), ("", "Wolfi"), ("d", "Debian:12"))]},
]


def test_a_feed_in_an_archive_with_counts(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "osv.zip", "w") as z:
        for i, r in enumerate(RECORDS):
            z.writestr(f"{i}.json", json.dumps(r))
        z.writestr("x.json", "no json")
    drops = T.Drops("OSV")
    records, bad = feeds.osv_archive(spark, str(tmp_path / "osv.zip"), drops)
    entries = feeds.osv_affected(records, drops)
    assert sorted(r.name for r in entries.collect()) == ["a", "c", "d", "w"] and [r.member for r in bad.collect()] == ["x.json"]
    counts = {s: (read, kept, {k: v for k, v in d.items() if v}) for _, s, read, kept, d in drops.counts()}
    assert counts == {"records": (6, 2, {"no id": 1, "withdrawn": 1, "malware": 1, "errata": 1}), "entries": (7, 4, {"no name": 1, "a line of its own": 1, "no range and no version": 1})}
    assert {(r.reason, r.n) for r in T.dropped(T.provenance(spark, drops)).filter("step = 'entries'").collect()} == {("no name", 1), ("a line of its own", 1), ("no range and no version", 1)}
    family = feeds.osv_affected(records, None, "Chainguard")
    assert sorted(r.name for r in family.collect()) == ["c", "w"]


def test_images_of_archives(spark, tmp_path):
    good = layer(("etc/os-release", "ID=alpine\nVERSION_ID=3.19.1\n"), ("lib/apk/db/installed", "P:musl\nV:1.2-r0\n\n"))
    tar_of(tmp_path / "a.tar", [("l/layer.tar", good), ("manifest.json", json.dumps([{"Layers": ["l/layer.tar", "m/layer.tar"]}]).encode())])
    tar_of(tmp_path / "b.tar", [("other", b"x")])
    (tmp_path / "c.tar").write_bytes(b"junk" * 999)
    blobs = images.read_archives(spark, str(tmp_path / "*.tar"))
    rows = {(os.path.basename(r.image_id), r.layer): (r.digest, r.content is not None) for r in blobs.collect()}
    assert rows["a.tar", 0] == ("l/layer.tar", True) and rows["a.tar", 1] == ("no layer m/layer.tar", False)
    assert rows["b.tar", 0] == ("no manifest.json that lists layers", False) and not rows["c.tar", 0][1]
    got = [(os.path.basename(r.image_id), r.name, r.kind) for r in images.catalog(blobs).collect()]
    assert ("a.tar", "musl", "apk") in got and ("a.tar", None, "layer") in got and ("b.tar", None, "layer") in got
