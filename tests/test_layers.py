from patchweave.operators import layers as L


def test_whiteouts(spark):
    e = [
        (1, 0, "etc/a", "file"), (1, 0, "etc/b", "file"), (1, 0, "lib/apk/db/installed", "file"), (1, 0, "opt/x/y", "file"), (1, 0, "top", "file"),
        (1, 1, "etc/.wh.a", "file"), (1, 1, "opt/.wh..wh..opq", "file"), (1, 1, "opt/z", "file"), (1, 1, "lib/.wh.apk", "file"),
        (1, 2, "etc/a", "file"), (1, 2, "etc/b", "link"), (1, 2, ".wh.top", "file"),
        (2, 0, "etc/a", "file"),
    ]
    df = spark.createDataFrame(e, "image_id long, layer int, path string, kind string")
    shown = L.visible(df)
    assert {(r.image_id, r.layer, r.path) for r in shown.collect()} == {(1, 2, "etc/a"), (1, 2, "etc/b"), (1, 1, "opt/z"), (2, 0, "etc/a")}
    assert {(r.image_id, r.path) for r in L.files_under(shown, "/etc").collect()} == {(1, "etc/a"), (2, "etc/a")}
    root = spark.createDataFrame([(1, 0, "a", "file"), (1, 1, ".wh..wh..opq", "file"), (1, 1, "b", "file")], df.schema)
    assert [r.path for r in L.visible(root).collect()] == ["b"]
