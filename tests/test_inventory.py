"""Parsers on small manifests, and the reader over a folder."""

import io
import json
import sqlite3
import struct
import zipfile

import pytest

from patchweave.sources import inventory as I


def pairs(packages):
    return [(p.name, p.version) for p in packages if isinstance(p, I.Package)]


def notes(packages):
    return [p.reason for p in packages if isinstance(p, I.Note)]


def test_lockfiles():
    assert pairs(I.npm_lock(json.dumps({"packages": {"": {"name": "root", "version": "1"}, "node_modules/a": {"version": "1.0.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0"}, "node_modules/l": {"link": True}}}))) == [("a", "1.0.0"), ("@s/b", "2.0.0")]
    assert sorted(pairs(I.npm_lock(json.dumps({"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2"}}}, "c": {}}})))) == [("a", "1"), ("b", "2")]
    assert pairs(I.yarn_lock('# yarn lockfile v1\n\n"@s/a@^1.0.0", "@s/a@^1.1.0":\n  version "1.2.0"\n\nb@npm:real@^2:\n  version "2.0.1"\n')) == [("@s/a", "1.2.0"), ("real", "2.0.1")]
    with pytest.raises(I.Unreadable):
        I.yarn_lock("__metadata:\n  version: 6\n")
    assert pairs(I.poetry_lock('[[package]]\nname = "a"\nversion = "1.0"\n')) == [("a", "1.0")]
    assert pairs(I.uv_lock('[[package]]\nname = "me"\nversion = "0"\nsource = { editable = "." }\n[[package]]\nname = "b"\nversion = "2"\n')) == [("me", "0"), ("b", "2")]
    assert pairs(I.cargo_lock('[[package]]\nname = "me"\nversion = "0"\n[[package]]\nname = "c"\nversion = "3"\nsource = "registry+x"\n')) == [("me", "0"), ("c", "3")]
    assert pairs(I.pipfile_lock(json.dumps({"default": {"a": {"version": "==1.0"}, "g": {"git": "x"}}, "develop": {"a": {"version": "==1.0"}, "r": {"version": ">=1"}}}))) == [("a", "1.0")]
    assert pairs(I.requirements("a==1.0 # c\nb[x]===2.0 ; python_version > '3'\n-r other.txt\nc>=1\nd @ https://x\ne==1.* \nf==\\\n3.0 --hash=sha256:0\n")) == [("a", "1.0"), ("b", "2.0"), ("f", "3.0")]
    assert pairs(I.gem_lock("GEM\n  remote: x\n  specs:\n    a (1.0)\n      b (>= 1)\n    n (2.0-x86_64-linux)\n\nPATH\n  specs:\n    p (1)\n")) == [("a", "1.0"), ("n", "2.0-x86_64-linux")]
    assert pairs(I.composer_lock(json.dumps({"packages": [{"name": "a/b", "version": "v1.0"}], "packages-dev": [{"name": "c/d", "version": "dev-main"}]}))) == [("a/b", "v1.0")]
    assert pairs(I.nuget_lock(json.dumps({"dependencies": {"net6": {"A": {"resolved": "1.0"}}, "net7": {"A": {"resolved": "1.0"}, "P": {"type": "Project"}}}}))) == [("A", "1.0")]


def test_go_mod():
    text = 'module m\nrequire (\n  a v1.0.0 // indirect\n  "b" v1.1.0\n)\nrequire c v1.2.0\nrequire d v1.0.0\nreplace a => x v9.0.0\nreplace b v1.1.0 => y v8.0.0\nreplace c => ../local\nexclude z v1.0.0\n'
    assert pairs(I.go_mod(text)) == [("x", "v9.0.0"), ("y", "v8.0.0"), ("d", "v1.0.0")]
    for bad in ("require (\na v1\n", ")\n"):
        with pytest.raises(I.Unreadable):
            I.go_mod(bad)


def test_system_databases():
    assert I.os_release('ID="alpine"\n# c\nVERSION_ID=3.19.1\n') == {"ID": "alpine", "VERSION_ID": "3.19.1"}
    got = I.apk_installed("P:a\nV:1.0-r0\no:src\n\nP:b\nV:2-r1\no:b\n")
    assert [(p.name, p.version, p.source_name) for p in got] == [("a", "1.0-r0", "src"), ("b", "2-r1", None)]
    assert pairs(I.dpkg_status("Package: h\nStatus: install ok half-installed\nVersion: 1\n")) == [("h", "1")]
    got = I.dpkg_status("Package: a\nStatus: install ok installed\nSource: s (2.0)\nVersion: 1.0-1\nDescription: x\n more\n\npackage: b\nStatus: deinstall ok config-files\nVersion: 1\n")
    assert [(p.name, p.version, p.source_name, p.source_version) for p in got] == [("a", "1.0-1", "s", "2.0")]


def header(**tags):
    number = {v: k for k, v in I._RPM_TAGS.items()}
    index = store = b""
    for k, v in tags.items():
        kind, data = (4, struct.pack(">I", v)) if isinstance(v, int) else (6, v.encode() + b"\0")
        index += struct.pack(">IIII", number[k], kind, len(store), 1)
        store += data
    return struct.pack(">II", len(tags), len(store)) + index + store


def test_rpm(tmp_path):
    path = tmp_path / "rpmdb.sqlite"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE Packages (hnum INTEGER PRIMARY KEY, blob BLOB)")
    for b in (header(name="a", version="1.0", release="2.el9", epoch=1, sourcerpm="src-1.0-2.el9.src.rpm", modularity="m:1:2:3"), header(name="gpg-pubkey", version="1", release="1"), b"bad"):
        con.execute("INSERT INTO Packages (blob) VALUES (?)", (b,))
    con.commit()
    con.close()
    p, bad = I.rpm_sqlite(path.read_bytes())
    assert isinstance(bad, I.Note)
    assert (p.name, p.version, p.source_name, p.source_version, p.module_stream) == ("a", "1:1.0-2.el9", "src", "1.0-2.el9", "m:1")
    with pytest.raises(I.Unreadable):
        I.rpm_sqlite(b"x")


def make_jar(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_sboms_and_jars():
    doc = {"bomFormat": "CycloneDX", "components": [{"type": "library", "purl": "pkg:npm/%40s/a@1.0", "components": [{"purl": "pkg:maven/g/b@2"}]}, {"type": "file", "purl": "pkg:npm/x@1"}, {"type": "library", "name": "none"}]}
    assert pairs(I.cyclonedx(json.dumps(doc))) == [("@s/a", "1.0"), ("g:b", "2")]
    doc = {"spdxVersion": "SPDX-2.3", "packages": [{"SPDXID": "r", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:npm/root@1"}]}, {"SPDXID": "p", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:pypi/q@2"}] * 2}], "relationships": [{"relationshipType": "DESCRIBES", "relatedSpdxElement": "r"}]}
    assert pairs(I.spdx(json.dumps(doc))) == [("q", "2")]
    inner = make_jar({"META-INF/maven/g/i/pom.properties": "groupId=g\nartifactId=i\nversion=2\n"})
    assert pairs(I.jar(make_jar({"META-INF/maven/g/o/pom.properties": "#c\ngroupId=g\nartifactId=o\nversion=1\n", "lib/i.jar": inner, "lib/bad.jar": "x"}))) == [("g:o", "1"), ("g:i", "2")]


def test_what_sboms_leave_out_is_noted():
    parts = [{"purl": "pkg:npm/a"}, {"name": "b"}, {"purl": "npm/c@1"}, {"purl": "pkg:swift/d@1"}, {"purl": "pkg:npm/e", "version": "2"}, {"type": "operating-system"}]
    found = I.cyclonedx(json.dumps({"bomFormat": "CycloneDX", "components": parts}))
    assert notes(found) == [I.NO_VERSION, I.NO_PURL, I.NO_PURL, I.OTHER_TYPE] and pairs([p for p in found if not isinstance(p, I.Note)]) == [("e", "2")]
    refs = lambda *urls: {"versionInfo": "9", "externalRefs": [{"referenceType": "purl", "referenceLocator": u} for u in urls]}
    doc = {"spdxVersion": "SPDX-2.2", "packages": [refs(), refs("x"), refs("pkg:npm/a", "pkg:swift/d@1"), refs("pkg:swift/d@1", "x"), refs("pkg:npm/b", "pkg:npm/c@1")]}
    found = I.spdx(json.dumps(doc))
    assert notes(found) == [I.NO_PURL, I.NO_PURL, I.NO_VERSION, I.OTHER_TYPE] and pairs(found[-1:]) == [("c", "1")]
    with pytest.raises(I.Unreadable):
        I.spdx('{"spdxVersion": "SPDX-3.0"}')


def test_an_sbom_s_distribution_places_its_packages(spark):
    system = lambda *ps, **own: {"type": "operating-system", "properties": [{"name": "syft:distro:" + k, "value": v} for k, v in ps], **own}
    deb = {"purl": "pkg:deb/x/p@1?distro=debian-11", "properties": [{"name": "syft:location:0:layerID", "value": "sha256:l"}, {"name": None}]}
    documents = {
        "named": [deb, system(("id", "debian"), ("versionID", "12"))],
        "own": [deb, system(name="debian", version="10")],
        "unknown": [deb, system(("id", "plan9"))],
        "nameless": [deb, system()],
        "first": [system(), deb, system(("id", "debian"), ("versionID", "12"))],
        "deep": [{"type": "file", "components": [system(("id", "debian"), ("versionID", "12"))]}, deb],
    }
    files = spark.createDataFrame([(f"/{k}/bom.json", bytearray(json.dumps({"bomFormat": "CycloneDX", "components": c}).encode())) for k, c in documents.items()], "path string, content binary")
    rows = {r.path.split("/")[1]: r for r in I.resolved(I.parse_files(files)).collect()}
    assert {k: r.ecosystem for k, r in rows.items()} == {"named": "Debian:12", "own": "Debian:10", "unknown": None, "nameless": "Debian:11", "first": "Debian:11", "deep": "Debian:11"}
    assert {r.layer for r in rows.values()} == {"sha256:l"} and {r.location for r in rows.values()} == {"sbom"}


def test_reader(spark, tmp_path):
    for name, body in {"x/go.mod": "require a v1.0.0\n", "y/yarn.lock": "__metadata:\n", "node_modules/z/go.mod": "require n v1\n", "z/requirements-dev.txt": "a==1\n", "q/pnpm-lock.yaml": "x", "other.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {(r.kind, r.ecosystem, r.name, r.version, r.reason is None) for r in I.read_inventory(spark, str(tmp_path)).collect()}
    assert got == {("gomod", "Go", "a", "v1.0.0", True), ("yarn", None, None, None, False), ("requirements", "PyPI", "a", "1", True), ("pnpm", None, None, None, False)}


def _zip(damage=None, encrypted=False, method=None):
    """A jar with one pom.properties; its headers or data are then changed."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/maven/g/a/pom.properties", "groupId=g\nartifactId=a\nversion=1\n" * 50)
    data = bytearray(buf.getvalue())
    for at, flag, kind in ((0, 6, 8), (data.index(b"PK\x01\x02"), 8, 10)):
        if encrypted:
            data[at + flag] |= 1
        if method is not None:
            data[at + kind : at + kind + 2] = method.to_bytes(2, "little")
    if damage is not None:
        at = data.index(b"pom.properties") + len(b"pom.properties")
        data[at : at + 8] = damage
    return bytes(data)


HOSTILE = {
    "encrypted.jar": _zip(encrypted=True), "unknown.jar": _zip(method=77), "damaged.jar": _zip(damage=b"\xff" * 8), "cut.jar": _zip()[:-30], "none.jar": b"PK\x03\x04",
    "package-lock.json": b"[" * 200_000, "bom.json": b'{"a":' * 200_000, "x.spdx.json": b"\xff\xfe", "poetry.lock": b"a = " + b"[" * 50_000, "uv.lock": b"\x00", "Cargo.lock": b"package = 3", "composer.lock": b'{"packages": 7}',
    "packages.lock.json": b'{"dependencies": [1]}', "Pipfile.lock": b"null", "rpmdb.sqlite": b"SQLite format 3\0" + b"\xff" * 4000, "Packages": b"\x00" * 600, "Packages.db": b"RpmP" + b"\xff" * 5000, "go.mod": b"require (\n", "yarn.lock": b"\"a@1\":\n  version",
}


def test_hostile_files_are_rows_with_a_reason(spark):
    files = spark.createDataFrame([("/x/" + n, bytearray(b)) for n, b in HOSTILE.items()], "path string, content binary")
    got = {}
    for r in I.parse_files(files).collect():
        got.setdefault(r.path[3:], []).append(r.reason)
    assert set(got) == set(HOSTILE) and all(any(reasons) for reasons in got.values()), got
    assert I.sniff("a", b'{"a":' * 200_000) is None and not I.looks_like_jar("a", b"PK\x03\x04zz")


def test_what_has_no_version_is_noted():
    assert notes(I.composer_lock(json.dumps({"packages": [{"name": "v/a", "version": "dev-main"}, {"name": "v/b", "version": "1.0"}]}))) == ["a branch, no version: v/a dev-main"]
    assert notes(I.npm_lock(json.dumps({"packages": {"": {}, "node_modules/a": {}, "node_modules/l": {"link": True}}}))) == ["no version: a"]
    assert notes(I.npm_lock(json.dumps({"dependencies": {"c": {}}}))) == ["no version: c"]


def test_order_of_packages(spark):
    rows = [("npm", "b", "1", "/x", None), ("npm", "a", "2", "/x", None), ("npm", "a", "10", "/y", None), ("npm", "a", "10", "/z", "/a"), ("Go", "z", "1", "/x", None), (None, "z", "1", "/x", None)]
    packages = spark.createDataFrame(rows, "ecosystem string, name string, version string, path string, location string").repartition(5)
    assert [(r.ecosystem, r["name"], r.version, r.path) for r in I.ordered_packages(packages).collect()] == [(None, "z", "1", "/x"), ("Go", "z", "1", "/x"), ("npm", "a", "10", "/z"), ("npm", "a", "10", "/y"), ("npm", "a", "2", "/x"), ("npm", "b", "1", "/x")]
