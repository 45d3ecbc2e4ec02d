"""Feed readers on small documents."""

import json

import pytest

from patchweave.sources import feeds as S


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(p)


def test_osv(spark, tmp_path):
    rec = lambda id, **k: {"id": id, "modified": "2024-01-02T03:04:05Z", "aliases": ["CVE-1"], "related": ["CVE-2"], "affected": [{"package": {"name": "n", "ecosystem": "Packagist:https://x"}, "ranges": [{"type": "GIT", "events": [{"introduced": "0"}]}, {"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.0.0"}]}]}, {"package": {"name": "u", "ecosystem": "Ubuntu:Pro:16.04:LTS"}, "versions": ["1"]}], **k}
    d = tmp_path / "osv"
    d.mkdir()
    for r in (rec("GHSA-1"), rec("DEBIAN-CVE-2"), rec("MAL-3"), rec("GHSA-4", withdrawn="2024-01-01T00:00:00Z"), rec("ALBA-5")):
        (d / f"{r['id']}.json").write_text(json.dumps(r))
    records = S.osv_records(spark, str(d))
    assert {(r.database, r.advisory_id, tuple(r.related)) for r in records.collect()} == {("GHSA", "GHSA-1", ()), ("DEBIAN", "DEBIAN-CVE-2", ("CVE-2",))}
    rows = S.osv_affected(records).collect()
    assert {(r.advisory_id, r.ecosystem, r.name) for r in rows} == {("GHSA-1", "Packagist", "n"), ("DEBIAN-CVE-2", "Packagist", "n")}
    assert [e.fixed for e in rows[0].ranges[0].events] == [None, "1.0.0"] and len(rows[0].ranges) == 1


def test_osv_streams_bounds_and_words(spark, tmp_path):
    aff = lambda eco, fixed: {"package": {"name": "n", "ecosystem": eco}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": fixed}]}]}
    el = "1-1.module+el8.5.0+1"
    recs = [
        {"id": "RLSA-1", "summary": "Moderate: python38:3.8 security update", "affected": [aff("Rocky Linux:8", el), aff("Rocky Linux:8", "1-1.el8"), aff("npm", el)]},
        {"id": "ALSA-2", "summary": "Important: nodejs:20 and nodejs:20 update", "affected": [aff("AlmaLinux:9", "1-1.module_el9")], "severity": [{"type": "CVSS_V3", "score": "x"}]},
        {"id": "RLSA-3", "summary": "Low: idm:DL1 and idm:client update", "affected": [aff("Rocky Linux:8", el)]},
        {"id": "RLSA-4", "summary": "Important: varnish security update", "affected": [aff("Rocky Linux", el)]},
        {"id": "ALPINE-5", "affected": [aff("Alpine:v3.19", "1.2.3.r4"), aff("Alpine:v3.19", "1.2-r3"), aff("Alpine:v3.19", "a.b.rc"), aff("Wolfi", "1.2.r3")]},
        {"id": "GHSA-6", "summary": "Low: a:b", "affected": [aff("Go", "1.0.0")]},
    ]
    d = tmp_path / "osv"
    d.mkdir()
    for r in recs:
        (d / f"{r['id']}.json").write_text(json.dumps(r))
    records = S.osv_records(spark, str(d)).cache()
    rows = {(r.advisory_id, r.aff_ord): r for r in S.osv_affected(records).collect()}
    assert {k: r.module_stream for k, r in rows.items() if r.module_stream} == {("RLSA-1", 0): "python38:3.8", ("ALSA-2", 0): "nodejs:20"}
    assert [rows["ALPINE-5", i].ranges[0].events[1].fixed for i in range(4)] == ["1.2.3-r4", "1.2-r3", "a.b.rc", "1.2.r3"]
    words = {r.advisory_id: [tuple(s) for s in r.severity] for r in records.collect()}
    assert words == {"RLSA-1": [("VENDOR_WORD", "Moderate")], "ALSA-2": [("CVSS_V3", "x")], "RLSA-3": [("VENDOR_WORD", "Low")], "RLSA-4": [("VENDOR_WORD", "Important")], "ALPINE-5": [], "GHSA-6": []}


def test_ratings(spark, tmp_path):
    nvd = {"totalResults": 2, "vulnerabilities": [{"cve": {"id": "CVE-1", "metrics": {"cvssMetricV31": [{"cvssData": {"vectorString": "CVSS:3.1/AV:N"}}], "cvssMetricV2": [{"cvssData": {"vectorString": "AV:N"}}]}}}, {"cve": {"id": "CVE-2", "metrics": {}}}]}
    (r,) = S.nvd_ratings(spark, put(tmp_path, "nvd.json", nvd)).collect()
    assert r.cve == "CVE-1" and [(s.type, s.score) for s in r.severity] == [("CVSS_V2", "AV:N"), ("CVSS_V3", "CVSS:3.1/AV:N")]
    (r,) = S.epss_ratings(spark, put(tmp_path, "epss.csv", "#model_version:v1,score_date:2024-01-01\ncve,epss,percentile\nCVE-1,0.5,0.9\nX,1,1\n")).collect()
    assert (r.cve, r.epss, r.epss_model) == ("CVE-1", 0.5, "v1")
    with pytest.raises(S.FeedError):
        S.epss_ratings(spark, put(tmp_path, "bad.csv", "#model_version:v1\nCVE-1,x,0.9\n"))
    kev = {"count": 1, "vulnerabilities": [{"cveID": "CVE-1", "dateAdded": "2024-01-02", "knownRansomwareCampaignUse": "Known"}]}
    (r,) = S.kev_ratings(spark, put(tmp_path, "kev.json", kev)).collect()
    assert r.kev and r.kev_ransomware and str(r.kev_date_added) == "2024-01-02"
    with pytest.raises(S.FeedError):
        S.kev_ratings(spark, put(tmp_path, "kev2.json", kev | {"count": 2}))


def test_catalogues_and_updates(spark, tmp_path):
    eol = {"total": 2, "result": [{"name": "debian", "releases": [{"name": "12", "eolFrom": "2026-06-10", "isLts": False, "isMaintained": True}]}, {"name": "windows", "releases": []}]}
    (r,) = S.eol_releases(spark, put(tmp_path, "eol.json", eol)).collect()
    assert (r.distro_id, r.release, r.eol_from, r.eoes_from) == ("debian", "12", "2026-06-10", "")
    kisa = {"resList": [{"id": "b", "title": "cve-2024-0001", "content_text": "x  y"}, {"id": "a", "title": "CVE-2024-0001", "content_text": "CVE-2024-0002"}]}
    got = {r.cve: (r.notice, r.claims) for r in S.notices(spark, put(tmp_path, "n.json", kisa)).collect()}
    assert got == {"CVE-2024-0001": ("b", 1), "CVE-2024-0002": ("a", 2)}
    xml = '<updates><update type="security"><id>ALAS-1</id><severity>medium</severity><references><reference type="cve" id="CVE-1"/><reference type="x" id="y"/></references><pkglist><collection><package name="a" epoch="1" version="2" release="3"/><package name="a" epoch="0" version="9" release="9"/><package name="b" epoch="0" version="1" release="1"/></collection></pkglist></update><update type="bugfix"><id>ALAS-2</id></update></updates>'
    rows = S.updateinfo_affected(spark, put(tmp_path, "u.xml", xml), "Amazon Linux:2").orderBy("name").collect()
    assert [(r.name, r.ranges[0].events[1].fixed, r.cves, r.word) for r in rows] == [("a", "1:2-3", ["CVE-1"], "Medium"), ("b", "1-1", ["CVE-1"], "Medium")]


def test_ubuntu_tracker_lines(spark):
    from patchweave.sources import distributions as U

    text = "Candidate: CVE-2024-1\r\nPublicDate: x\nfocal_bash: needed\njammy_bash: ignored (end of: life)\nnoble_bash:\nnoble_b ad: needed\nwarty_bash: needed\nfocal_-x: needed\nfocal_zsh: released (1.0-1)\nnoble_fish: deferred (2024-01-01) more\nxenial_lib+c.d-1: pending\nfocal_bash: DNE\n jammy_zsh: needed\n"
    files = spark.createDataFrame([("a", text), ("b", "Candidate: CVE-24-1\nfocal_x: needed\n"), ("c", "Candidate: CVE-2024-1\nxenial_lib+c.d-1: ignored\n"), ("d", None)], "path string, value string")
    got = {(r.cve, r.name, r.release): r.fix_state for r in U.ubuntu_states(files).collect()}
    assert got == {("CVE-2024-1", "bash", "20.04"): None, ("CVE-2024-1", "bash", "22.04"): "wont-fix", ("CVE-2024-1", "zsh", "20.04"): None, ("CVE-2024-1", "lib+c.d-1", "16.04"): "wont-fix"}
