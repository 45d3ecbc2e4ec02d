"""Package inventories from manifests and package databases.

read_inventory() lists files with Spark's binaryFile source, picks a parser by name and parses files in Arrow batches,
one file at a time; a file that can't be read is a row with its reason, never silently nothing. Parsers are plain
functions from text or bytes to Package rows.
"""

from __future__ import annotations

import io
import json
import re
import struct
import tarfile
import tomllib
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchweave.functions import names as N
from patchweave.sources import sqlite_pages

#: Directories that are never read.
PRUNED = ("node_modules", "vendor", ".git")
MAX_ARCHIVE_DEPTH = 3
MAX_ENTRY_BYTES = 512 << 20


@dataclass(frozen=True)
class Package:
    ecosystem: str | None
    name: str
    version: str
    source_name: str | None = None
    source_version: str | None = None
    module_stream: str | None = None
    purl: str | None = None
    location: str | None = None
    layer: str | None = None
    distro: str | None = None
    distro_version: str | None = None
    distro_name: str | None = None


@dataclass(frozen=True)
class Note:
    """Something that was left out, with the reason: a row of its own in the result."""

    reason: str


class Unreadable(ValueError):
    """The file isn't what its name says, with the reason."""


#: What readers raise on files that are damaged, encrypted, packed in unknown ways, nested without end or made to do
#: harm. RuntimeError holds unknown methods and endless recursion, ValueError what isn't text, JSON or a number.
READ_ERRORS = (ValueError, ArithmeticError, AttributeError, TypeError, LookupError, RuntimeError, EOFError, MemoryError, OSError, struct.error, zlib.error, zipfile.BadZipFile, tarfile.TarError)


def why(e: BaseException) -> str:
    return f"{type(e).__name__}: {e}"


def _json(text: str) -> dict:
    try:
        data = json.loads(text)
    except (ValueError, RecursionError) as e:
        raise Unreadable(f"not JSON: {e}") from None
    if not isinstance(data, dict):
        raise Unreadable("not a JSON object")
    return data


def _once(packages: Iterable[Package | Note]) -> list[Package | Note]:
    return list(dict.fromkeys(packages))


# ---- lockfiles ----


def npm_lock(text: str) -> list[Package | Note]:
    """package-lock.json and npm-shrinkwrap.json: the packages map of versions 2 and 3, else nested dependencies. What
    has no version is noted; links are what they point to, which has an entry of its own."""
    data = _json(text)
    out: list[Package | Note] = []
    if isinstance(data.get("packages"), dict):
        for path, p in sorted(data["packages"].items()):
            name = p.get("name") if "node_modules/" not in path else path.rsplit("node_modules/", 1)[1]
            if path and not p.get("link") and name:
                out.append(Package("npm", name, p["version"]) if p.get("version") else Note(f"no version: {name}"))
        return _once(out)
    todo = [data.get("dependencies") or {}]
    while todo:
        for name, p in sorted(todo.pop().items()):
            out.append(Package("npm", name, p["version"]) if p.get("version") else Note(f"no version: {name}"))
            if isinstance(p.get("dependencies"), dict):
                todo.append(p["dependencies"])
    return _once(out)


def yarn_lock(text: str) -> list[Package]:
    """Version 1 only; an npm: alias stands for the package behind it."""
    if "__metadata:" in text:
        raise Unreadable("a Berry lockfile")
    out, name = [], None
    for line in text.splitlines():
        if line and line[0] not in " #":
            spec = line.rstrip(":").split(",")[0].strip().strip('"')
            alias = re.match(r".+?@npm:(@?[^@]+)", spec)
            name = alias[1] if alias else spec[: spec.rfind("@")] if "@" in spec[1:] else None
        elif name and (m := re.match(r'  version:? "?([^"\s]+)"?', line)):
            out.append(Package("npm", name, m[1]))
            name = None
    return _once(out)


def _toml_packages(ecosystem: str, text: str) -> list[Package]:
    """Every package with a name and a version, whatever its source: a local one is installed, too."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise Unreadable(f"not TOML: {e}") from None
    if "package" not in data:
        raise Unreadable("no [[package]] table")
    return _once(Package(ecosystem, p["name"], p["version"]) for p in data["package"] if p.get("name") and p.get("version"))


def poetry_lock(text: str) -> list[Package]:
    return _toml_packages("PyPI", text)


def uv_lock(text: str) -> list[Package]:
    return _toml_packages("PyPI", text)


def cargo_lock(text: str) -> list[Package]:
    return _toml_packages("crates.io", text)


def pipfile_lock(text: str) -> list[Package]:
    data = _json(text)
    rows = [(n, p.get("version", "")) for part in ("default", "develop") for n, p in sorted((data.get(part) or {}).items()) if isinstance(p, dict)]
    return _once(Package("PyPI", n, v[2:].strip()) for n, v in rows if re.fullmatch(r"==\s*[^*,]+", v))


_PIN = re.compile(r"([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*===?\s*([^\s;,*]+)\s*(?:;.*)?")


def requirements(text: str) -> list[Package | Note]:
    """Lines that pin one version; comments and options are none, and other requirements (URLs, ranges) are noted."""
    logical = re.sub(r"\\\r?\n", " ", text).splitlines()
    lines = (re.sub(r"(^|\s)#.*", "", x).split(" --hash")[0].strip() for x in logical)
    named = (x for x in lines if x and x[0] != "-")
    return _once(Package("PyPI", m[1], m[2]) if (m := _PIN.fullmatch(x)) else Note(f"not pinned to one version: {x}") for x in named)


def gem_lock(text: str) -> list[Package]:
    """Specs at an indent of four in a GEM section."""
    out, section = [], ""
    for line in text.splitlines():
        if line and not line[0].isspace():
            section = line.strip()
        elif section == "GEM" and (m := re.fullmatch(r" {4}(\S+) \(([^)]+)\)", line)):
            out.append(Package("RubyGems", m[1], m[2]))
    return _once(out)


def composer_lock(text: str) -> list[Package | Note]:
    """Packages of both sections; a branch has no version that could be compared and is noted."""
    data = _json(text)
    rows = [p for part in ("packages", "packages-dev") for p in data.get(part) or [] if p.get("name") and p.get("version")]
    return _once(Note(f"a branch, no version: {p['name']} {p['version']}") if p["version"].startswith("dev-") else Package("Packagist", p["name"], p["version"]) for p in rows)


def nuget_lock(text: str) -> list[Package]:
    frameworks = _json(text).get("dependencies") or {}
    return _once(Package("NuGet", n, p["resolved"]) for _, deps in sorted(frameworks.items()) for n, p in sorted(deps.items()) if p.get("resolved"))


def go_mod(text: str) -> list[Package]:
    """Requirements with replacements applied: one of that version before one of any version; a path has no version."""
    required, exact, general, block = [], {}, {}, None
    for raw in text.splitlines():
        line = re.sub(r"//.*", "", raw).strip()
        if not line:
            continue
        if line == ")":
            if block is None:
                raise Unreadable("a block ends that never began")
            block = None
            continue
        m = re.fullmatch(r"(\w+)\s*\(", line)
        if m and block is None:
            block = m[1]
            continue
        verb, _, rest = (block, None, line) if block else line.partition(" ")
        words = [w.strip('"`') for w in rest.split()]
        if verb == "require" and len(words) >= 2:
            required.append((words[0], words[1]))
        elif verb == "replace" and "=>" in words:
            at = words.index("=>")
            target = (words[at + 1], words[at + 2] if len(words) > at + 2 else None)
            if at == 2:
                exact[words[0], words[1]] = target
            else:
                general[words[0]] = target
    if block is not None:
        raise Unreadable("a block that doesn't end")
    found = (exact.get(r) or general.get(r[0]) or r for r in required)
    return _once(Package("Go", n, v) for n, v in found if v)


# ---- operating-system databases ----


def os_release(text: str) -> dict[str, str]:
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def apk_installed(text: str) -> list[Package]:
    out = []
    for record in re.split(r"\n\s*\n", text):
        f = dict(line.split(":", 1) for line in record.splitlines() if re.match(r"[A-Za-z]:", line))
        if f.get("P") and f.get("V"):
            origin = f.get("o") or None
            out.append(Package(None, f["P"], f["V"], origin if origin != f["P"] else None))
    return out


def dpkg_status(text: str) -> list[Package]:
    """Stanzas whose files may be on disk, half-installed ones too; Source: name (version) names the source package."""
    out = []
    for stanza in re.split(r"\n[ \t]*\n", text):
        f = {k.lower(): v.strip() for k, v in re.findall(r"(?m)^([!-9;-~]+):[ \t]*(.*(?:\n[ \t]+.*)*)", stanza)}
        status = f.get("status", "install ok installed").split()
        if f.get("package") and f.get("version") and status[-1] in ("installed", "half-configured", "half-installed", "triggers-awaited", "triggers-pending", "unpacked"):
            m = re.fullmatch(r"(\S+)(?:\s+\((.+)\))?", f.get("source", ""))
            out.append(Package(None, f["package"], f["version"], m[1] if m else None, m[2] if m else None))
    return out


#: Tags of an rpm header.
_RPM_TAGS = {1000: "name", 1001: "version", 1002: "release", 1003: "epoch", 1022: "arch", 1044: "sourcerpm", 5096: "modularity"}


def rpm_header(blob: bytes) -> Package | None:
    """A package from a header blob: counts, an index of (tag, type, offset, count), a store; all big-endian."""
    if len(blob) < 8:
        raise Unreadable("a short rpm header")
    n, size = struct.unpack(">II", blob[:8])
    store = 8 + 16 * n
    if n > 65_536 or store + size > len(blob):
        raise Unreadable("an rpm header beyond its bounds")
    values: dict[str, str] = {}
    for i in range(n):
        tag, kind, offset, _ = struct.unpack(">IIII", blob[8 + 16 * i : 24 + 16 * i])
        if tag not in _RPM_TAGS or offset >= size:
            continue
        at = store + offset
        if kind in (6, 8, 9):
            values[_RPM_TAGS[tag]] = blob[at : blob.index(b"\0", at)].decode("utf-8", "replace")
        elif kind == 4:
            values[_RPM_TAGS[tag]] = str(struct.unpack(">I", blob[at : at + 4])[0])
    if not values.get("name") or not values.get("version") or values["name"] == "gpg-pubkey":
        return None
    evr = (f"{values['epoch']}:" if values.get("epoch", "0") != "0" else "") + values["version"] + (f"-{values['release']}" if values.get("release") else "")
    source = re.fullmatch(r"(.+)-([^-]+-[^-]+)\.src\.rpm", values.get("sourcerpm", ""))
    label = values.get("modularity", "").split(":")
    return Package(None, values["name"], evr, source[1] if source else None, source[2] if source else None, ":".join(label[:2]) if len(label) > 1 else None)


def _rpm_packages(blobs: Iterable[bytes]) -> list[Package | Note]:
    out: list[Package | Note] = []
    for n, b in enumerate(blobs):
        try:
            p = rpm_header(b)
        except (Unreadable, struct.error, ValueError) as e:
            out.append(Note(f"rpm record {n}: {e}"))
            continue
        if p:
            out.append(p)
    return out


def rpm_sqlite(data: bytes) -> list[Package | Note]:
    """rpmdb.sqlite: the blobs of table Packages, from the file's pages. A database in write-ahead mode whose log isn't
    empty is refused by the caller, who sees the log (see images.py)."""
    try:
        blobs = sqlite_pages.table_column(data, "Packages", "blob")
    except sqlite_pages.Damaged as e:
        raise Unreadable(f"rpmdb: {e}") from None
    return _rpm_packages(b if isinstance(b, bytes) else b"" for b in blobs)


def rpm_bdb(data: bytes) -> list[Package | Note]:
    """BerkeleyDB's hash file Packages, in either byte order: values of hash pages, inline or in chains of overflow
    pages; the key 0 holds a counter."""
    order = next((o for o in "<>" if len(data) >= 72 and struct.unpack(o + "I", data[12:16])[0] == 0x061561), None)
    if order is None:
        raise Unreadable("not a BerkeleyDB hash file")
    size, last = struct.unpack(order + "I", data[20:24])[0], struct.unpack(order + "I", data[32:36])[0]
    if not 512 <= size <= 65_536 or (last + 1) * size > len(data):
        raise Unreadable("BerkeleyDB pages beyond the file's end")

    def page(n: int) -> bytes:
        if not 0 < n <= last:
            raise Unreadable(f"BerkeleyDB page {n} of {last}")
        return data[n * size : (n + 1) * size]

    def overflow(n: int, length: int) -> bytes:
        out, seen = bytearray(), set()
        while n and len(out) < length:
            if n in seen:
                raise Unreadable("BerkeleyDB overflow pages in a circle")
            seen.add(n)
            p = page(n)
            out += p[26 : 26 + struct.unpack(order + "H", p[22:24])[0]]
            n = struct.unpack(order + "I", p[16:20])[0]
        if len(out) < length:
            raise Unreadable("a BerkeleyDB value that ends early")
        return bytes(out[:length])

    blobs = []
    for n in range(1, last + 1):
        p = page(n)
        if p[25] not in (2, 13):
            continue
        entries = struct.unpack(order + "H", p[20:22])[0]
        at = struct.unpack(f"{order}{entries}H", p[26 : 26 + 2 * entries])
        for i in range(1, entries, 2):
            if p[at[i]] == 3:  # in overflow pages
                start, length = struct.unpack(order + "II", p[at[i] + 4 : at[i] + 12])
                blobs.append(overflow(start, length))
            elif p[at[i]] == 1 and p[at[i - 1] + 1 : at[i - 2] if i >= 2 else size] != b"\0" * 4:
                blobs.append(p[at[i] + 1 : at[i - 1]])
    return _rpm_packages(blobs)


def rpm_ndb(data: bytes) -> list[Package | Note]:
    """ndb's Packages.db: slots of (package, block, blocks), each blob with its head, tail and checksum."""
    if data[:4] != b"RpmP" or len(data) < 32:
        raise Unreadable("not an ndb database")
    pages = struct.unpack("<I", data[12:16])[0]
    if not 0 < pages * 4096 <= len(data):
        raise Unreadable("ndb slots beyond the file's end")
    blobs, bad = [], []
    for at in range(32, pages * 4096, 16):
        magic, index, block, count = struct.unpack("<4sIII", data[at : at + 16])
        if magic != b"Slot" or not block:
            continue
        region = data[block * 16 : (block + count) * 16]
        head, number, _, length = struct.unpack("<4sIII", region[:16]) if len(region) >= 32 else (b"", 0, 0, 0)
        checksum, again, tail = struct.unpack("<II4s", region[-12:]) if len(region) >= 32 else (0, 0, b"")
        if head != b"BlbS" or tail != b"BlbE" or number != index or again != length or -(-(28 + length) // 16) != count or zlib.adler32(region[:-12]) != checksum:
            bad.append(Note(f"ndb package {index} is damaged"))
        else:
            blobs.append(region[16 : 16 + length])
    return _rpm_packages(blobs) + bad


# ---- Go binaries ----


def go_version(text: str) -> str | None:
    """A toolchain's version as a semantic version: go1.22rc1 is 1.22.0-rc.1; None for a development build."""
    m = re.fullmatch(r"(?:go)?((?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){0,2})(?:-(\S*)|(rc|beta|alpha)([0-9]+))?", text)
    if not m:
        return None
    numbers = m[1].split(".")
    before = m[2] or (f"{m[3]}.{m[4]}" if m[3] else "")
    return ".".join(numbers + ["0"] * (3 - len(numbers))) + (f"-{before}" if before else "")


def go_binary(data: bytes) -> list[Package | Note]:
    """The build information of a Go program: its modules, as replaced, and the standard library. The form of
    toolchains before 1.18, which points into the program's memory, is refused."""
    at = data.find(b"\xff Go buildinf:")
    while at >= 0 and at % 16:
        at = data.find(b"\xff Go buildinf:", at + 1)
    if at < 0:
        raise Unreadable("no Go build information")
    if not data[at + 15] & 2:
        raise Unreadable("build information of a toolchain before 1.18")

    def text(n: int) -> tuple[bytes, int]:
        length = shift = 0
        while True:
            b = data[n]
            length |= (b & 127) << shift
            n, shift = n + 1, shift + 7
            if b < 128:
                return data[n : n + length], n + length

    try:
        toolchain, n = text(at + 32)
        modules, _ = text(n)
    except IndexError:
        raise Unreadable("build information that ends early") from None
    modules = modules[16:-16] if len(modules) >= 33 and modules[-17:-16] == b"\n" else modules
    found: list[list[str]] = []
    for line in modules.decode("utf-8", "replace").splitlines():
        word, *rest = line.split("\t")
        if word in ("mod", "dep") and rest:
            found.append(rest)
        elif word == "=>" and found and rest:
            found[-1] = rest
    out: list[Package | Note] = []
    for path, version in ((m[0], m[1] if len(m) > 1 else "") for m in found):
        known = version not in ("", "(devel)")
        out.append(Package("Go", path, version, purl=f"pkg:golang/{path}@{version}") if known else Note(f"{path} has no version"))
    std = go_version(toolchain.decode("utf-8", "replace"))
    out.append(Package("Go", "stdlib", std, purl=f"pkg:golang/stdlib@{std}") if std else Note("the toolchain has no version"))
    return out


# ---- SBOMs and archives ----

_DISTRO_TYPES = ("rpm", "deb", "apk")
_PURL_TYPES = {"golang": "Go", "npm": "npm", "pypi": "PyPI", "cargo": "crates.io", "gem": "RubyGems", "composer": "Packagist", "nuget": "NuGet", "maven": "Maven"}


#: Properties in which an inventory tool writes what package URLs don't hold.
_PROPERTIES = {"location": "syft:location:0:path", "layer": "syft:location:0:layerID", "origin": "syft:metadata:originPackage", "label": "syft:metadata:modularityLabel", "distro": "syft:distro:id", "distro_version": "syft:distro:versionID", "distro_name": "syft:distro:prettyName"}
#: Why a component of an SBOM gives no package.
NO_PURL, NO_VERSION, OTHER_TYPE, NO_INSTALL = "a component without a package URL", "a component without a version", "a component of another ecosystem", "a source package or a public key"


def from_purl(purl: str, version: str = "") -> Package | Note:
    """A language package by its package URL, with the component's version where the URL has none; one of a
    distribution as it is named, for resolved() to complete; a note for what is no package URL, other types and those
    without a version."""
    m = re.fullmatch(r"pkg:/*([^/?#]+)/([^?#]+)(?:\?[^#]*)?(?:#.*)?", purl)
    if not m:
        return Note(NO_PURL)
    kind = m[1].lower()
    if kind not in (*_PURL_TYPES, *_DISTRO_TYPES):
        return Note(OTHER_TYPE)
    path, _, own = m[2].strip("/").rpartition("@")
    if not path:
        path, own = own, ""
    version = unquote(own) or version
    if not version:
        return Note(NO_VERSION)
    parts = [unquote(x) for x in path.split("/")]
    if kind in _DISTRO_TYPES:
        return Package(None, parts[-1], version, purl=purl, location="sbom")
    return Package(_PURL_TYPES[kind], (":" if kind == "maven" else "/").join(parts), version, purl=purl, location="sbom")


def _properties(component: dict) -> dict[str, str]:
    """The first value of each property of a component, by the short names of _PROPERTIES; empty ones don't count."""
    told: dict[str, str] = {}
    for p in component.get("properties") or []:
        told.setdefault(p.get("name"), p.get("value"))
    return {k: told[name] for k, name in _PROPERTIES.items() if told.get(name)}


def _document_distro(components: list[dict]) -> dict[str, str | None]:
    """The distribution of a document, from its first component at the top that is an operating system; the component's
    own name and version stand in for missing properties. Empty where there is none or it has no name."""
    system = next((c for c in components if c.get("type") == "operating-system"), None)
    if system is None:
        return {}
    told = _properties(system)
    name = told.get("distro") or system.get("name")
    return {"distro": name, "distro_version": told.get("distro_version") or system.get("version"), "distro_name": told.get("distro_name")} if name else {}


def cyclonedx(text: str) -> list[Package | Note]:
    """Components at any depth, each a package or a note; operating systems and files are neither. Packages carry the
    document's distribution wherever it stands in the text, where they lie and their layer; Alpine's source package and
    Red Hat's module stream come from properties."""
    data = _json(text)
    if data.get("bomFormat") != "CycloneDX":
        raise Unreadable("no CycloneDX document")
    top = data.get("components") or []
    distro = _document_distro(top)
    out: list[Package | Note] = []
    todo = list(reversed(top))
    while todo:
        c = todo.pop()
        todo.extend(reversed(c.get("components") or []))
        if c.get("type") in ("operating-system", "file"):
            continue
        p = from_purl(c.get("purl") or "", c.get("version") or "")
        if isinstance(p, Package):
            told = _properties(c)
            own = {k: told[k] for k in ("location", "layer") if k in told}
            kind = p.purl[4:].lstrip("/").split("/")[0].lower()
            if kind == "apk" and told.get("origin"):
                own["source_name"] = told["origin"]
            elif kind == "rpm" and told.get("label"):
                name, _, rest = told["label"].partition(":")
                stream, _, rest = rest.partition(":")
                if name and stream and ":" in rest:
                    own["module_stream"] = f"{name}:{stream}"
            p = replace(p, **own, **distro)
        out.append(p)
    return out


#: Releases of SPDX that are read.
SPDX_VERSIONS = ("SPDX-2.2", "SPDX-2.3")


def spdx(text: str) -> list[Package | Note]:
    """Packages by their purl references, each once; the one that the document describes is left out. A package of
    which no reference gives anything is a note. Only a package URL tells a version."""
    data = _json(text)
    if data.get("spdxVersion") not in SPDX_VERSIONS:
        raise Unreadable(f"no SPDX document of a release that is read: {data.get('spdxVersion')}")
    own = data.get("SPDXID") or ""
    root = next((r.get("relatedSpdxElement") for r in data.get("relationships") or [] if r.get("relationshipType") == "DESCRIBES" and (r.get("spdxElementId") or "") == own), None)
    out: list[Package | Note] = []
    for p in data.get("packages") or []:
        if root and p.get("SPDXID") == root:
            continue
        found = [from_purl(r.get("referenceLocator") or "") for r in p.get("externalRefs") or [] if r.get("referenceType") == "purl"]
        packages = [f for f in found if isinstance(f, Package)]
        # A language package is told by name and version; a distribution's URL also by its qualifiers.
        out.extend({(f.ecosystem, f.name, f.version, None if f.ecosystem else f.purl): f for f in packages}.values() if packages else _worst(found))
    return out


def _worst(notes: list[Note]) -> list[Note]:
    """What to say of a package whose references give nothing: a missing version first, then another ecosystem."""
    reasons = {n.reason for n in notes}
    return [Note(next((r for r in (NO_VERSION, OTHER_TYPE) if r in reasons), NO_PURL))]


def jar(data: bytes, depth: int = 0) -> list[Package | Note]:
    """Every pom.properties of an archive and of archives within it; entries over the caps, nested archives that can't
    be read and archives without a pom.properties are noted."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except READ_ERRORS:
        raise Unreadable("not an archive") from None
    out = []
    for e in sorted(archive.infolist(), key=lambda e: e.filename):
        nested = re.search(r"\.(jar|war|ear)$", e.filename)
        if (nested or e.filename.endswith("pom.properties")) and e.file_size > MAX_ENTRY_BYTES:
            out.append(Note(f"{e.filename}: larger than {MAX_ENTRY_BYTES} bytes"))
            continue
        if re.fullmatch(r"META-INF/maven/.+/pom\.properties", e.filename):
            try:
                text = archive.read(e).decode("utf-8", "replace")
            except READ_ERRORS as x:
                out.append(Note(f"{e.filename}: {why(x)}"))
                continue
            f = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and line[0] != "#")
            if f.get("groupId") and f.get("artifactId") and f.get("version"):
                out.append(Package("Maven", f"{f['groupId'].strip()}:{f['artifactId'].strip()}", f["version"].strip()))
        elif nested and depth >= MAX_ARCHIVE_DEPTH:
            out.append(Note(f"{e.filename}: nested more than {MAX_ARCHIVE_DEPTH} deep"))
        elif nested:
            try:
                out.extend(jar(archive.read(e), depth + 1))
            except READ_ERRORS as x:
                out.append(Note(f"{e.filename}: {x}"))
    if depth and not out:
        out.append(Note("an archive without a pom.properties"))
    return _once(out)


def looks_like_jar(name: str, data: bytes) -> bool:
    """An archive by its first bytes that is named as one or has a META-INF folder."""
    if not data.startswith(b"PK\x03\x04"):
        return False
    if re.search(r"\.(jar|war)$", name):
        return True
    try:
        return any(n.startswith("META-INF/") for n in zipfile.ZipFile(io.BytesIO(data)).namelist())
    except READ_ERRORS:
        return False


def sniff(name: str, data: bytes) -> str | None:
    """What a single file is, when nothing says so: gobinary, jar, cyclonedx or spdx; None if none of them."""
    if b"\xff Go buildinf:" in data:
        return "gobinary"
    if looks_like_jar(name, data):
        return "jar"
    try:
        keys = json.loads(data)
    except (ValueError, RecursionError):
        return None
    if isinstance(keys, dict):
        return "cyclonedx" if "bomFormat" in keys else "spdx" if "spdxVersion" in keys else None
    return None


#: Prefixes that say what a target is.
TARGET_PREFIXES = {"docker-archive:": "image", "oci-dir:": "image", "sbom:": "sbom", "dir:": "directory", "file:": "gobinary", "jar:": "jar"}


def classify(targets: DataFrame) -> DataFrame:
    """target, is_directory, content (null where it doesn't exist) with kind and path: an explicit prefix counts first,
    then a directory, then what the content is; what doesn't exist is an image's reference, what is none of them has a
    null kind."""

    @F.pandas_udf("string")
    def by_content(name: pd.Series, content: pd.Series) -> pd.Series:
        kinds = {"cyclonedx": "sbom", "spdx": "sbom"}
        return pd.Series([None if c is None else (lambda k: kinds.get(k, k))(sniff(n, c)) for n, c in zip(name, content, strict=True)], dtype=object)

    kind, path = None, F.col("target")
    for prefix, k in TARGET_PREFIXES.items():
        has = F.col("target").startswith(prefix)
        kind = F.when(has, k) if kind is None else kind.when(has, k)
        if k != "image":
            path = F.when(has, F.substr("target", F.lit(len(prefix) + 1))).otherwise(path)
    told = targets.withColumn("told", kind)
    unknown = F.col("told").isNull() & ~F.col("is_directory")
    found = told.withColumn("seen", by_content("target", F.when(unknown, F.col("content"))))
    decided = F.coalesce("told", F.when(F.col("is_directory"), "directory").when(F.col("content").isNull(), "image"), "seen")
    return found.select("target", decided.alias("kind"), path.alias("path"))


#: File name or suffix -> (kind, parser, whether it takes bytes).
PARSERS: list[tuple[str, str, Callable, bool]] = [
    (r"(package-lock|npm-shrinkwrap)\.json", "npm", npm_lock, False),
    (r"yarn\.lock", "yarn", yarn_lock, False),
    (r"poetry\.lock", "poetry", poetry_lock, False),
    (r"uv\.lock", "uv", uv_lock, False),
    (r"Cargo\.lock", "cargo", cargo_lock, False),
    (r"Pipfile\.lock", "pipfile", pipfile_lock, False),
    (r"requirements[^/]*\.txt", "requirements", requirements, False),
    (r"Gemfile\.lock", "gem", gem_lock, False),
    (r"composer\.lock", "composer", composer_lock, False),
    (r"packages\.lock\.json", "nuget", nuget_lock, False),
    (r"go\.mod", "gomod", go_mod, False),
    (r"installed", "apk", apk_installed, False),
    (r"status", "dpkg", dpkg_status, False),
    (r"rpmdb\.sqlite", "rpm", rpm_sqlite, True),
    (r"Packages", "rpm", rpm_bdb, True),
    (r"Packages\.db", "rpm", rpm_ndb, True),
    (r".+\.cdx\.json|bom\.json", "cyclonedx", cyclonedx, False),
    (r".+\.spdx\.json", "spdx", spdx, False),
    (r".+\.(jar|war)", "jar", jar, True),
]
FIELDS = ("ecosystem", "name", "version", "source_name", "source_version", "module_stream", "purl", "location", "layer", "distro", "distro_version", "distro_name")
SCHEMA = "path string, kind string, reason string, " + ", ".join(f"{f} string" for f in FIELDS)


def parse_file(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA for one file; one row with a reason where it can't be read."""
    base = path.rsplit("/", 1)[-1]
    blank = (None,) * len(FIELDS)
    for pattern, kind, parser, binary in PARSERS:
        if re.fullmatch(pattern, base):
            try:
                found = parser(content if binary else content.decode("utf-8-sig"))
            except READ_ERRORS as e:
                yield (path, kind, why(e), *blank)
                return
            for p in found:
                yield (path, kind, p.reason, *blank) if isinstance(p, Note) else (path, kind, None, *(getattr(p, f) for f in FIELDS))
            if not found:
                yield (path, kind, "no package", *blank)
            return
    if base == "pnpm-lock.yaml":
        yield (path, "pnpm", "this format isn't read", *blank)


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from (path, content)."""
    schema = pa.schema([(c.split()[0], pa.string()) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(parse_file(b.column("path")[i].as_py(), b.column("content")[i].as_py() or b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def resolved(packages: DataFrame, document_ecosystem: str = "document_ecosystem") -> DataFrame:
    """Rows of SCHEMA whose distribution packages (by package URL) get their ecosystem, version with epoch, source and
    module stream. The distribution that the document names places them, even if advisories have no key for it; a
    column document_ecosystem that isn't null counts before it. What the document tells of a source or a stream counts
    before the URL. Source packages and public keys become rows with a reason; packages that nothing places keep a null
    ecosystem, which no guard lets pass as clean."""
    given = F.col(document_ecosystem) if document_ecosystem in packages.columns else F.lit(None).cast("string")
    told = N.distro_ecosystem(F.col("distro"), F.col("distro_version"), F.col("distro_name"))
    document, named = F.coalesce(given, told), given.isNotNull() | F.col("distro").isNotNull()
    rows = packages.withColumn("__p", N.parse_purl(F.col("purl")))
    rows = rows.withColumn("__d", N.distro_purl(F.col("__p"), F.col("version"), document, named))
    placed, out = F.col("__d").isNotNull(), F.coalesce("__d.skip", F.lit(False))
    value = {
        "ecosystem": F.when(placed, F.col("__d.ecosystem")).otherwise(F.col("ecosystem")),
        "version": F.coalesce("__d.version", "version"),
        "source_name": F.coalesce("source_name", "__d.source_name"),
        "module_stream": F.coalesce("module_stream", "__d.module_stream"),
    }
    blank = lambda c: F.when(~out, value.get(c, F.col(c))).alias(c)
    return rows.select(*(F.when(out, NO_INSTALL).otherwise(F.col("reason")).alias(c) if c == "reason" else blank(c) if c in FIELDS else F.col(c) for c in packages.columns))


def components(rows: DataFrame) -> DataFrame:
    """What became of each SBOM's components, by resolved rows: path, components, cataloged, no_purl, no_version,
    unsupported. Every component counts once, but for SPDX packages that name several. Documents that can't be read
    count none."""
    has = F.col("name").isNotNull()
    is_ = lambda *r: F.col("reason").isin(*r)
    one = has | is_(NO_PURL, NO_VERSION, OTHER_TYPE, NO_INSTALL)
    return rows.filter("kind in ('cyclonedx', 'spdx')").groupBy("path").agg(
        F.count_if(one).alias("components"), F.count_if(has).alias("cataloged"), F.count_if(is_(NO_PURL)).alias("no_purl"),
        F.count_if(is_(NO_VERSION)).alias("no_version"), F.count_if(is_(OTHER_TYPE, NO_INSTALL)).alias("unsupported"),
    )


def ordered_packages(packages: DataFrame) -> DataFrame:
    """Packages by ecosystem, name, version and where they lie, nulls first, sorted over ranges of keys."""
    return packages.orderBy("ecosystem", "name", "version", F.coalesce("location", "path"))


def manifests(rows: DataFrame) -> DataFrame:
    """What became of each file: path, kind, packages, notes, failed (nothing could be read), reason (its first one)."""
    named = F.col("name").isNotNull()
    g = rows.groupBy("path", "kind").agg(F.count_if(named).alias("packages"), F.count_if(F.col("reason").isNotNull()).alias("notes"), F.min("reason").alias("reason"))
    return g.withColumn("failed", (F.col("packages") == 0) & (F.col("reason") != "no package"))


#: Directories below the root that a walk looks into.
MAX_DEPTH = 6


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """The packages of all manifests under a folder, to a depth of MAX_DEPTH folders; deeper manifests are rows with a
    reason. Distribution packages of SBOMs are resolved by their URLs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    pruned = "/(" + "|".join(map(re.escape, PRUNED)) + ")/"
    named = "/(" + "|".join(p for p, *_ in PARSERS) + r"|pnpm-lock\.yaml)$"
    below = F.size(F.split(F.element_at(F.split("path", re.escape(root.rstrip("/"))), -1), "/")) - 2
    wanted = files.filter(F.col("path").rlike(named) & ~F.col("path").rlike(pruned)).withColumn("depth", below)
    deep = wanted.filter(F.col("depth") > MAX_DEPTH).select("path", F.lit(None).cast("string").alias("kind"), F.lit("deeper than the walk goes").alias("reason"), *(F.lit(None).cast("string").alias(f) for f in FIELDS))
    return resolved(parse_files(wanted.filter(F.col("depth") <= MAX_DEPTH))).unionByName(deep)
