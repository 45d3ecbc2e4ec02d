"""Names, package URLs and ecosystem keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Purl types and the ecosystems that they stand for.
PURL_ECOSYSTEMS = {"golang": "Go", "npm": "npm", "pypi": "PyPI", "cargo": "crates.io", "gem": "RubyGems", "composer": "Packagist", "nuget": "NuGet", "maven": "Maven"}
_PURL = r"^pkg:/*([^/?#@]+)/([^?#]*?)(?:\?([^#]*))?(?:#.*)?$"


def normalize_name(ecosystem: Column, name: Column) -> Column:
    """The name by which an ecosystem looks packages up: PyPI folds case and runs of -_., NuGet folds case."""
    return F.when(ecosystem == "PyPI", F.regexp_replace(F.lower(name), "[-_.]+", "-")).when(ecosystem == "NuGet", F.lower(name)).otherwise(name)


def percent_decode(text: Column) -> Column:
    """URL decoding that leaves a plus sign alone; null where an escape is broken."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def parse_purl(purl: Column) -> Column:
    """struct(type, namespace, name, version, qualifiers); null if it is no package URL. The version follows the last @;
    of a repeated qualifier the first counts."""
    kind = F.lower(F.regexp_extract(purl, _PURL, 1))
    path = F.regexp_replace(F.regexp_extract(purl, _PURL, 2), "^/+|/+$", "")
    cut = F.length(path) - F.coalesce(F.nullif(F.instr(F.reverse(path), "@"), F.lit(0)), F.length(path) + 1)
    has_version = F.contains(path, F.lit("@")) & (cut > 0)
    bare = F.when(has_version, F.substr(path, F.lit(1), cut)).otherwise(path)
    version = F.when(has_version, percent_decode(F.substr(path, cut + 2)))
    parts = F.split(bare, "/")
    name = percent_decode(F.element_at(parts, -1))
    namespace = F.when(F.size(parts) > 1, F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), percent_decode), "/"))
    pairs = F.filter(F.transform(F.split(F.regexp_extract(purl, _PURL, 3), "&"), lambda q: F.struct(F.lower(F.substring_index(q, "=", 1)).alias("k"), percent_decode(F.regexp_extract(q, "^[^=]*=(.*)$", 1)).alias("v"))), lambda q: (q["k"] != "") & (q["v"] != ""))
    first = F.filter(pairs, lambda q, i: F.array_position(F.transform(pairs, lambda p: p["k"]), q["k"]) == i + 1)
    return F.when(purl.rlike(_PURL) & (name != ""), F.struct(kind.alias("type"), namespace.alias("namespace"), name.alias("name"), version.alias("version"), F.map_from_entries(first).alias("qualifiers")))


def purl_ecosystem(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PURL_ECOSYSTEMS.items() for x in pair))
    return F.try_element_at(table, kind)


def source_rpm_name(label: Column) -> Column:
    """name of name-version-release.src.rpm."""
    return F.nullif(F.regexp_extract(label, r"^(.+)-[^-]+-[^-]+\.src\.rpm$", 1), F.lit(""))


def module_stream(label: Column) -> Column:
    """name:stream of name:stream:version:context; null where a label has fewer parts or empty ones."""
    parts = F.split(label, ":", 4)
    return F.when((F.size(parts) == 4) & (parts[0] != "") & (parts[1] != ""), F.concat_ws(":", parts[0], parts[1]))


def nevra(text: Column) -> Column:
    """struct(name, evr) of name-epoch:version-release: the name ends at the last dash before the first colon; without
    a colon all is the name and evr is empty."""
    pattern = "^([^:]*)-([^:-]*:.*)$"
    split = text.rlike(pattern)
    return F.struct(F.when(split, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("name"), F.when(split, F.regexp_extract(text, pattern, 2)).otherwise("").alias("evr"))


def nvr(text: Column) -> Column:
    """struct(name, version, release) of name-version-release; null where a part is missing."""
    pattern = "^(.+)-([^-]+)-([^-]+)$"
    t = F.trim(text)
    return F.when(t.rlike(pattern), F.struct(*(F.regexp_extract(t, pattern, i + 1).alias(n) for i, n in enumerate(("name", "version", "release")))))


def evr(epoch: Column, version: Column, release: Column) -> Column:
    """epoch:version-release, without an epoch of 0."""
    e = F.coalesce(epoch.cast("string"), F.lit(""))
    return F.concat(F.when(e.isin("", "0"), "").otherwise(F.concat(e, F.lit(":"))), version, F.lit("-"), release)


def database_of(advisory_id: Column) -> Column:
    """What precedes the first dash; empty if there is none."""
    return F.regexp_extract(advisory_id, "^([^-]+)-", 1)


#: Os-release IDs whose key is their name and a numbered major release.
_BY_MAJOR = {"debian": "Debian", "rhel": "Red Hat", "rocky": "Rocky Linux", "almalinux": "AlmaLinux", "ol": "Oracle Linux"}


def distro_ecosystem(distro: Column, version: Column, pretty: Column | None = None) -> Column:
    """The ecosystem key of a distribution by os-release ID, VERSION_ID and PRETTY_NAME; null where the distribution or
    the release is none that advisories are keyed by. Ubuntu's pretty name tells a long-term release; without one
    April releases of even years are."""
    v = F.coalesce(version, F.lit(""))
    name = F.coalesce(pretty, F.lit("")) if pretty is not None else F.lit("")
    major, minor = F.regexp_extract(v, "^([0-9]+)(?:[.].*)?$", 1), F.regexp_extract(v, "^[0-9]+[.]([0-9]+)(?:[.].*)?$", 1)
    two = v.rlike("^[0-9]+[.][0-9]+$")
    lts = F.contains(name, F.lit("LTS")) | ((name == "") & (minor == "04") & (major.try_cast("int") % 2 == 0))
    key = (
        F.when((distro == "alpine") & (minor != ""), F.concat(F.lit("Alpine:v"), major, F.lit("."), minor))
        .when(distro == "wolfi", "Wolfi")
        .when(distro == "chainguard", "Chainguard")
        .when((distro == "ubuntu") & v.rlike("^[0-9]{2}[.][0-9]{2}$"), F.concat(F.lit("Ubuntu:"), v, F.when(lts, ":LTS").otherwise("")))
        .when((distro == "amzn") & v.isin("2", "2023"), F.concat(F.lit("Amazon Linux:"), v))
        .when((distro == "fedora") & v.rlike("^[0-9]+$"), F.concat(F.lit("Fedora:"), v))
        .when((distro == "sles") & two & (major.try_cast("int") >= 16), F.concat(F.lit("SLES:"), v))
        .when((distro == "sles") & two, F.concat(F.lit("SLES:"), major, F.when(minor != "0", F.concat(F.lit(".SP"), minor)).otherwise("")))
        .when((distro == "opensuse-leap") & two, F.concat(F.lit("openSUSE Leap:"), v))
    )
    for d, family in _BY_MAJOR.items():
        key = key.when((distro == d) & (major != ""), F.concat(F.lit(family + ":"), major))
    return key


def eol_cycle(ecosystem: Column) -> Column:
    """The release of an ecosystem key as end-of-life catalogues write it; null for keys without a release. A SLES
    service pack is a second number, and none is 0."""
    release = F.regexp_replace(F.split_part(ecosystem, F.lit(":"), F.lit(2)), "^v", "")
    sles = F.when(F.contains(release, F.lit(".SP")), F.replace(release, F.lit(".SP"), F.lit("."))).when(F.contains(release, F.lit(".")), release).otherwise(F.concat(release, F.lit(".0")))
    return F.when(release != "", F.when(ecosystem.startswith("SLES:"), sles).otherwise(release))


def distro_purl(purl: Column, version: Column, document_ecosystem: Column, has_distro: Column) -> Column:
    """struct(ecosystem, version, source_name, module_stream, skip) of a parsed rpm, deb or apk package URL.

    A document that names a distribution gives the ecosystem; else the qualifier distro (id-version) does, or, for rpm,
    the Red Hat repository. rpm and deb prepend a non-zero epoch. upstream names the source, rpmmod the module stream.
    skip: source packages and public keys. ecosystem is null where nothing tells it."""
    kind = purl["type"]
    q = lambda name: F.coalesce(F.try_element_at(purl["qualifiers"], F.lit(name)), F.lit(""))
    named = "^(.+)-([^-]+)$"
    stated = distro_ecosystem(F.regexp_extract(q("distro"), named, 1), F.regexp_extract(q("distro"), named, 2))
    redhat = F.regexp_extract(q("repository_id"), "^rhel-([0-9]+)-", 1)
    by_repository = F.when((kind == "rpm") & (redhat != ""), F.concat(F.lit("Red Hat:"), redhat))
    ecosystem = F.when(has_distro, document_ecosystem).otherwise(F.coalesce(stated, by_repository))
    own = F.coalesce(purl["version"], F.lit(""))
    epoch = F.when(kind.isin("rpm", "deb") & ~q("epoch").isin("", "0"), F.concat(q("epoch"), F.lit(":"))).otherwise("")
    source = F.when(kind == "rpm", source_rpm_name(q("upstream"))).otherwise(F.nullif(F.substring_index(q("upstream"), "@", 1), F.lit("")))
    skip = (kind == "rpm") & ((q("arch") == "src") | ((purl["name"] == "gpg-pubkey") & (q("arch") == "")))
    return F.when(
        kind.isin("rpm", "deb", "apk"),
        F.struct(ecosystem.alias("ecosystem"), F.when(own == "", version).otherwise(F.concat(epoch, own)).alias("version"), source.alias("source_name"), F.when(kind == "rpm", module_stream(q("rpmmod"))).alias("module_stream"), skip.alias("skip")),
    )
