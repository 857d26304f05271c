"""Sources, sinks and page extraction on small files."""

from pyspark.sql import functions as F

from faultline.functions import pages
from faultline.sources import arff, logs

ARFF = "% note\n@relation toy-1\n@ATTRIBUTE wmc REAL\n@ATTRIBUTE loc REAL\n@ATTRIBUTE class {0,1,3}\n\n@data\n1.5,20,0\n\n2.5,30,3\n"


def test_arff(spark, tmp_path):
    (tmp_path / "a.arff").write_text(ARFF)
    (tmp_path / "b.arff").write_text(ARFF.replace("toy-1", "toy-2"))
    got = arff.read(spark, arff.list_files(str(tmp_path)), None, True).orderBy("id").collect()
    assert [(r["id"], r["f1"], r["label"]) for r in got] == [("toy-1-0", 20.0, 0.0), ("toy-1-1", 30.0, 1.0), ("toy-2-0", 20.0, 0.0), ("toy-2-1", 30.0, 1.0)]
    assert arff.read(spark, [str(tmp_path / "a.arff")], [1]).columns == ["id", "project", "f1", "label"]
    arff.register(spark)
    df = spark.read.format("arff").load(str(tmp_path))
    assert df.count() == 4 and df.columns == ["id", "project", "wmc", "loc", "class"]


def test_log_dump(spark, tmp_path):
    end = ";=;;-\n"
    rec = lambda n, d: f"changeset:ab{n}{end}changeshort:ab{end}revision:{n}{end}author:A <a@b>{end}date:{d}{end}summary:Bug {n}: x{end}branches:{end}tags:{end}parents:3:cd -1:000{end}files:a/b.c---c.h---{end}============================\n"
    p = tmp_path / "dump.txt"
    p.write_text(rec(7, "2012-01-02 03:04 -0200") + rec(8, "none") + "x;=;;-\n============================\n")
    got = logs.read_log_dump(spark, str(p)).orderBy("locid").collect()
    assert len(got) == 2 and got[0]["parents"] == ["3:cd"] and got[0]["files"] == ["a/b.c", "c.h"] and got[0]["m"] == "Bug 7: x"
    assert got[0]["timestamp"] == 1325480640.0 and got[1]["timestamp"] is None


def test_metric_files_and_store(spark, tmp_path):
    (tmp_path / "MI-1").write_text("5;0;abc;1\t\t2.5\n5;1;abd;4\n")
    m = logs.read_metric_files(spark, str(tmp_path / "MI-1"), 4).orderBy("rev_index").collect()
    assert m[0]["metrics"] == [1.0, 0.0, 2.5, 0.0] and m[1]["metrics"] == [4.0, 0.0, 0.0, 0.0]
    s = logs.Store(spark, str(tmp_path / "store"))
    df = spark.range(5).selectExpr("id", "id * 2 AS x")
    s.insert(df, "t"), s.insert(df, "t")
    assert s.get("t", ["x"], "id = 3").count() == 2 and s.query("SELECT max(x) m FROM t", "t").first()["m"] == 8
    s.clean("t")
    assert s.get("t").count() == 0


def test_blame_round_trip(spark, tmp_path):
    row = ("c1", "12", "4:a/b.c", "@:r1-3-17", "r1:r2-4-18", "old()", "new()")
    df = spark.createDataFrame([row, tuple(None for _ in row)], ", ".join(f"{c} string" for c in logs.BLAME_FIELDS))
    logs.write_blames(df, str(tmp_path / "b"))
    got = logs.read_blames(spark, str(tmp_path / "b")).orderBy(F.desc("commit")).collect()
    assert len(got) == 2 and tuple(got[0][c] for c in logs.BLAME_FIELDS) == row and (got[0]["file_id"], got[0]["blamed_idx"], got[0]["blamed_line"]) == ("4", 3, 17)


BUG = """<html><span id='field-value-creation_ts'><span title='2012-01-02 PST'>x</span></span><div id='field-value-status-view'>RESOLVED
 FIXED</div><a id='field-value-assigned_to'>Ann<br></a><i id='field-value-reporter'>Bob</i><b id='product-name'>Core</b>
<table id='attachments'><tr class='patch'><td><div><a href='x?id=99'>fix</a></div><div><a href='#c1'><span title='2012-02-02 pst'></span></a><span><div><a>Ann</a></div></span></div><div>3 KB</div></td><td><div><div><span>Bob</span></div><a>review+</a></div></td></tr></table></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, BUG), (2, "you are not authorized to access bug 2"), (3, None)], "bug long, html string")
    got = {r["bug"]: r for r in pages.extract_bugs(df).collect()}
    assert got[1]["state"] == 1 and got[1]["assignedTo"] == "Ann" and got[1]["product"] == "Core" and got[1]["reportDateText"] == "2012-01-02 PST" and got[1]["version"] == ""
    assert got[2]["state"] == -1 and got[3]["state"] == 0
    p = pages.extract_patches(df).collect()
    assert len(p) == 1 and (p[0]["patchId"], p[0]["author"], p[0]["patchSize"], p[0]["patchFlagTypes"], p[0]["patchFlagStatus"], p[0]["patchFlagUsers"]) == (99, "Ann", "3 KB", "review+", "+", "Bob")
    t = spark.createDataFrame([("<td>push date</td><td>Mon Jan 02</td>", "rename from a\nrename to b\n")], "h string, d string")
    assert t.select(pages.push_date_text(F.col("h"))).first()[0] == "Mon Jan 02" and t.select(pages.renamed(F.col("d"))).first()[0][0]["copy_to"] == "b"
