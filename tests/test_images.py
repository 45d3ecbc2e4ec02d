"""Images from layers to packages, links and whiteouts, and the database formats."""

import gzip
import hashlib
import io
import json
import struct
import tarfile
import zlib

import pytest

from patchweave.sources import images as G
from patchweave.sources import inventory as V


def layer(*files, links=()):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w") as t:
        for name, text in files:
            data = text if isinstance(text, bytes) else text.encode()
            m = tarfile.TarInfo("./" + name)
            m.size = len(data)
            t.addfile(m, io.BytesIO(data))
        for name, target in links:
            m = tarfile.TarInfo(name)
            m.type, m.linkname = tarfile.SYMTYPE, target
            t.addfile(m)
    return buf.getvalue()


def header(name, version, release, epoch=None, source=None, module=None):
    tags = [(1000, 6, name), (1001, 6, version), (1002, 6, release), (1044, 6, source), (5096, 6, module), (1003, 4, epoch)]
    index, store = b"", b""
    for tag, kind, value in (t for t in tags if t[2] is not None):
        index += struct.pack(">IIII", tag, kind, len(store), 1)
        store += struct.pack(">I", value) if kind == 4 else value.encode() + b"\0"
    return struct.pack(">II", len(index) // 16, len(store)) + index + store


def bdb(blobs, order="<", size=512):
    """A hash file: a page of metadata, one hash page, and overflow pages for the values."""
    pages, entries = [], [(b"\0\0\0\0", b"\x05\0\0\0")]
    start = 2
    for i, b in enumerate(blobs):
        chunks = [b[j : j + size - 26] for j in range(0, len(b), size - 26)]
        for j, c in enumerate(chunks):
            following = start + j + 1 if j + 1 < len(chunks) else 0
            p = bytearray(size)
            p[16:20], p[22:24], p[25] = struct.pack(order + "I", following), struct.pack(order + "H", len(c)), 7
            p[26 : 26 + len(c)] = c
            pages.append(bytes(p))
        entries.append((struct.pack(order + "I", i + 1), (start, len(b))))
        start += len(chunks)
    h, at, offsets = bytearray(size), size, []
    for k, v in entries:
        for item in (b"\1" + k, b"\1" + v if isinstance(v, bytes) else b"\3\0\0\0" + struct.pack(order + "II", *v)):
            at -= len(item)
            h[at : at + len(item)] = item
            offsets.append(at)
    h[20:22], h[25] = struct.pack(order + "H", len(offsets)), 13
    h[26 : 26 + 2 * len(offsets)] = struct.pack(f"{order}{len(offsets)}H", *offsets)
    meta = bytearray(size)
    meta[12:16], meta[20:24], meta[32:36] = (struct.pack(order + "I", x) for x in (0x061561, size, start - 1))
    return bytes(meta) + bytes(h) + b"".join(pages)


def ndb(blobs, damage=False):
    slots, body, block = b"", b"", 256
    for i, b in enumerate(blobs, 1):
        count = -(-(28 + len(b)) // 16)
        region = (struct.pack("<4sIII", b"BlbS", i, 0, len(b)) + b).ljust(count * 16 - 12, b"\0")
        region += struct.pack("<II4s", zlib.adler32(region) ^ damage, len(b), b"BlbE")
        slots += struct.pack("<4sIII", b"Slot", i, block, count)
        body, block = body + region, block + count
    return (struct.pack("<4sIIIIIII", b"RpmP", 0, 1, 1, 0, 0, 0, 0) + slots).ljust(4096, b"\0") + body


NAMES = [header("bash", "5.1", "2.el9", epoch=1, source="bash-src-5.1-2.el9.src.rpm"), header("perl", "5", "1", module="perl:5.30:8030:x86"), header("gpg-pubkey", "1", "1"), header("long" + "x" * 900, "1", "1")]


def test_rpm_databases():
    want = [("bash", "1:5.1-2.el9", "bash-src"), ("perl", "5-1", None), ("long" + "x" * 900, "1-1", None)]
    for data, reader in ((bdb(NAMES), V.rpm_bdb), (bdb(NAMES, ">"), V.rpm_bdb), (ndb(NAMES), V.rpm_ndb)):
        assert [(p.name, p.version, p.source_name) for p in reader(data)] == want
    assert all(isinstance(p, V.Note) for p in V.rpm_ndb(ndb(NAMES[:1], damage=True)))
    for bad in (b"", b"RpmP", bdb(NAMES)[:600]):
        with pytest.raises(V.Unreadable):
            V.rpm_bdb(bad)
        with pytest.raises(V.Unreadable):
            V.rpm_ndb(bad)


def test_go_binary():
    mod = "path\tx\nmod\tm\tv1.0.0\nmod2\ndep\ta/b\tv1.2.3\th1:\n=>\tc/d\tv2.0.0\ndep\te\t(devel)\n"
    body = b"\0" * 16 + mod.encode() + b"\0" * 16
    varint = lambda n: bytes([n & 127 | 128, n >> 7]) if n > 127 else bytes([n])
    data = b"x" * 32 + b"\xff Go buildinf:" + bytes([8, 2]) + b"\0" * 16 + varint(8) + b"go1.22rc" + varint(len(body)) + body
    found = V.go_binary(data)
    assert [(p.name, p.version) for p in found if isinstance(p, V.Package)] == [("m", "v1.0.0"), ("c/d", "v2.0.0")]
    assert len([p for p in found if isinstance(p, V.Note)]) == 2
    assert [V.go_version(v) for v in ("go1.22.3", "go1.21", "go1.22rc1", "devel go1.23-abc", "go01.2", "go1.20-x")] == ["1.22.3", "1.21.0", "1.22.0-rc.1", None, None, "1.20.0-x"]
    with pytest.raises(V.Unreadable):
        V.go_binary(b"nothing")


OS = 'ID=alpine\nVERSION_ID=3.19.1\nPRETTY_NAME="Alpine Linux v3.19"\n'


def test_catalog(spark):
    apk = "P:musl\nV:1.2-r0\n\nP:libcrypto3\nV:3.1-r0\no:openssl\n"
    rows = [
        # Links on the path and on a folder above it; a newer layer replaces the database.
        ("a", 0, "d0", layer(("usr/lib/os-release", OS), ("usr/lib/apk/db/installed", "P:old\nV:1\n"), links=[("etc/os-release", "../usr/lib/os-release"), ("lib", "usr/lib")])),
        ("a", 1, "d1", gzip.compress(layer(("usr/lib/apk/db/installed", apk)))),
        # status.d, and a status that a whiteout hides.
        ("b", 0, "e0", layer(("etc/os-release", "ID=debian\nVERSION_ID=\"12\"\n"), ("var/lib/dpkg/status", "Package: gone\nVersion: 1\n"), ("var/lib/dpkg/status.d/x", "Package: x\nVersion: 2\n"), ("var/lib/dpkg/status.d/x.md5sums", "junk"))),
        ("b", 1, "e1", layer(("var/lib/dpkg/.wh.status", ""))),
        ("c", 0, "f0", layer(("etc/os-release", "ID=fedora\nVERSION_ID=40\n"))),
        ("d", 0, "g0", layer(("etc/os-release", "ID=sles\nVERSION_ID=15.6\n"), ("usr/lib/sysimage/rpm/Packages.db", ndb(NAMES[:2])))),
        ("e", 0, "h0", layer(("etc/x", ""), links=[("lib", "lib")])),
    ]
    blobs = spark.createDataFrame(rows, "image_id string, layer int, digest string, content binary")
    got = {}
    for r in G.catalog(blobs).collect():
        got.setdefault(r.image_id, set()).add((r.ecosystem, r.name, r.version, r.digest) if r.name else r.reason)
    assert got == {
        "a": {("Alpine:v3.19", "musl", "1.2-r0", "d1"), ("Alpine:v3.19", "libcrypto3", "3.1-r0", "d1")},
        "b": {("Debian:12", "x", "2", "e0")},
        "c": {"it calls itself fedora, but has no rpm database"},
        "d": {("SLES:15.SP6", "bash", "1:5.1-2.el9", "g0"), ("SLES:15.SP6", "perl", "5-1", "g0")},
        "e": {"no package database"},
    }


def test_archives_and_layouts(spark, tmp_path):
    one = layer(("etc/os-release", OS), ("lib/apk/db/installed", "P:a\nV:1\n"))
    save = layer(("l/layer.tar", one), ("manifest.json", json.dumps([{"Layers": ["l/layer.tar"]}])))
    (tmp_path / "saved").mkdir()
    (tmp_path / "saved" / "x.tar").write_bytes(save)
    assert [r.name for r in G.catalog(G.read_archives(spark, str(tmp_path / "saved"))).collect()] == ["a"]
    blobs = tmp_path / "oci" / "img" / "blobs" / "sha256"
    blobs.mkdir(parents=True)

    def put(data):
        data = data if isinstance(data, bytes) else json.dumps(data).encode()
        d = hashlib.sha256(data).hexdigest()
        (blobs / d).write_bytes(data)
        return "sha256:" + d

    other = put({"layers": [{"digest": put(b"no tar")}]})
    right = put({"layers": [{"digest": put(one)}]})
    p = lambda d, os="linux", arch="amd64": {"digest": d, "platform": {"os": os, "architecture": arch}}
    inner = put({"manifests": [p(other, arch="arm64"), p(other, os="unknown"), p(right)]})
    (tmp_path / "oci" / "img" / "index.json").write_text(json.dumps({"manifests": [{"digest": inner}]}))
    assert [r.name for r in G.catalog(G.read_layouts(spark, str(tmp_path / "oci"))).collect()] == ["a"]


def test_classify(spark):
    jar = io.BytesIO()
    import zipfile

    with zipfile.ZipFile(jar, "w") as z:
        z.writestr("META-INF/x", "")
    rows = [("dir:/x", False, None), ("/folder", True, None), ("nginx:1", False, None), ("prog", False, b"..\xff Go buildinf:.."), ("a.bin", False, jar.getvalue()), ("s.json", False, b'{"bomFormat": "CycloneDX"}'), ("t.json", False, b'{"spdxVersion": "2.3"}'), ("u", False, b"?"), ("sbom:x", False, None), ("oci-dir:/i", False, None)]
    got = {r.target: (r.kind, r.path) for r in V.classify(spark.createDataFrame(rows, "target string, is_directory boolean, content binary")).collect()}
    assert got == {"dir:/x": ("directory", "/x"), "/folder": ("directory", "/folder"), "nginx:1": ("image", "nginx:1"), "prog": ("gobinary", "prog"), "a.bin": ("jar", "a.bin"), "s.json": ("sbom", "s.json"), "t.json": ("sbom", "t.json"), "u": (None, "u"), "sbom:x": ("sbom", "x"), "oci-dir:/i": ("image", "oci-dir:/i")}


def test_broken_layers_and_archives_are_rows_with_a_reason(spark):
    """One broken layer doesn't fail the others' images, and its own never looks clean."""
    good = layer(("etc/os-release", "ID=alpine\nVERSION_ID=3.19.1\n"), ("lib/apk/db/installed", "P:musl\nV:1.2-r0\n\n"))
    packed = gzip.compress(good)
    rows = [("a", 0, "d", good), ("b", 0, "d", good), ("b", 1, "e", b"no archive"), ("c", 0, "d", packed[: len(packed) // 2]), ("d", 0, "why", None)]
    blobs = spark.createDataFrame([(i, n, d, c if c is None else bytearray(c)) for i, n, d, c in rows], "image_id string, layer int, digest string, content binary")
    got = {}
    for r in G.catalog(blobs).collect():
        got.setdefault(r.image_id, []).append((r.name, r.kind, r.reason))
    assert got["a"] == [("musl", "apk", None)]
    assert {k for _, k, _ in got["b"]} == {"apk", "layer"} and any(n == "musl" for n, _, _ in got["b"])
    assert any(k == "layer" and why for _, k, why in got["c"]) and ("layer", "why") in {(k, why) for _, k, why in got["d"]}
    archives = spark.createDataFrame([("x", bytearray(b"junk")), ("y", bytearray(layer(("manifest.json", "[" * 100_000))))], "image_id string, content binary")
    assert {(r.image_id, r.layer, r.content, bool(r.digest)) for r in G.archive_layers(archives).collect()} == {("x", 0, None, True), ("y", 0, None, True)}
