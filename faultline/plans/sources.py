"""Queries over sources and sinks: what is written is read back by the library, and SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import pages
from faultline.functions.misc import read_components
from faultline.operators import history as H, lsh
from faultline.plans.standins import FEATURES, INST, inst
from faultline.plans.szz import _BL, _LINES, _REV, _blames, _lined, _texts
from faultline.session import scratch, table
from faultline.sources import arff, logs


def _arff_files(s, d, label):
    """One file a project: a head and a data line a part."""
    root = scratch(s)
    line = F.concat_ws(",", *[F.col(f).cast("string") for f in FEATURES], F.col(label).cast("string"))
    rows = inst(s, d).groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x.line), "\n").alias("data"))
    head = "".join(f"@attribute {f} REAL\n" for f in [*FEATURES, "class"])
    rows.select("project", F.concat(F.lit("@relation "), "project", F.lit("\n" + head + "\n@data\n"), "data").alias("value")).write.partitionBy("project").text(root)
    return [f"{root}/project=*/*.txt"]


def _log_dump(s, d):
    root = scratch(s)
    log = table(s, d, "repolog").groupBy("id").agg(F.min("cid").alias("cid"), F.min("loaded_at").alias("at"), F.min("author").alias("author"))
    field = lambda k, v: F.concat(F.lit(f"{k}:"), v, F.lit(logs.FIELD_END))
    text = F.concat(
        field("changeset", F.col("cid")), field("revision", F.col("id").cast("string")), field("author", F.regexp_replace("author", r"[:;\n]", " ")), field("date", F.date_format("at", "yyyy-MM-dd HH:mm '+0000'")),
        field("parents", F.concat(F.lit("3:"), F.col("cid"), F.lit(" -1:000"))), field("files", F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".c---b.h---"))),
    )
    log.where("cid IS NOT NULL AND author IS NOT NULL").select(text.alias("value")).write.option("lineSep", logs.RECORD_END).text(root)
    got = logs.read_log_dump(s, root)
    return got.select("locid", "cid", "author", F.array_join("parents", " ").alias("parents"), F.array_join("files", " ").alias("files"), F.col("timestamp").cast("bigint").alias("seconds"))


def _store(s, d):
    """Inserted twice, replaced, cleaned; then a filtered scan of what was inserted after."""
    store = logs.Store(s, scratch(s))
    bugs = table(s, d, "validbugs").select("bug", "status", "component")
    store.insert(bugs, "bugs"), store.replace(bugs, "bugs"), store.clean("bugs"), store.insert(bugs, "bugs"), store.insert(bugs, "bugs")
    store.insert(table(s, d, "users").select("id", "username"), "people")
    return store.get("bugs", ["bug", "upper(status) AS status"], "component IS NOT NULL").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bug").alias("n_bugs")).unionByName(store.query("SELECT 'people' AS status, count(*) AS n, count(DISTINCT username) AS n_bugs FROM people", "people"))


def _metric_files(s, d):
    root = scratch(s)
    table(s, d, "part").select(F.concat_ws(";", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), "p_brand", F.concat_ws("\t", F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_retailprice").cast("string")))).alias("value")).write.text(root)
    return logs.read_metric_files(s, root, 3).select("fid", "rev_index", "rev_id", F.array_join(F.transform("metrics", lambda x: F.round(x, 2).cast("string")), ",").alias("metrics"))


def _blame_records(s, d):
    root = scratch(s)
    b = _blames(s, d).select("blamer", "blamed", "bug", "file_id", "kind", F.col("component")).distinct()
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    logs.write_blames(b.select(
        F.col("blamer").cast("string").alias("commit"), F.col("bug").cast("string").alias("bug"), text(F.col("file_id"), ":src/x.c").alias("file"), text("r0:", F.col("blamed"), "-4-17").alias("blamed"), text("r0:", F.col("blamer"), "-5-18").alias("fixing"),
        F.col("kind").alias("blamed_code"), F.col("component").alias("fixing_code"),
    ), root)
    got = logs.read_blames(s, root)
    return got.groupBy("file_id", "file_name", "blamed_code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("blamed_rev").alias("n_revs"), F.sum("blamed_idx").alias("idx"), F.sum("blamed_line").alias("lines"))


def _csv(s, d):
    root = scratch(s)
    logs.write_instances(inst(s, d), [*FEATURES, "label"], root)
    cells = F.split("value", ",")
    return s.read.text(root).select(*[cells[k].cast("double").alias(f) for k, f in enumerate([*FEATURES, "label"])])


_PAGE = """concat('<html><div id="field-value-status-view">', x_status, '</div><b id="product-name"> ', x_product, ' </b><i id="component-name">', x_component, '</i><span id="field-value-creation_ts"><span title="', x_date, '">d</span></span><table id="attachments"><tr class="patch"><td><div><a href="attachment.cgi?id=', bug, '">fix ', bug,
 '</a></div><div><a href="#c"><span title="', x_date, '"></span></a></div><div>', bug % 90, ' KB</div></td><td></td></tr></table><table><tr><td>push date</td><td>', x_date, '</td></tr></table></html>')"""
_PAGED = "SELECT bug, coalesce(min(status), '') AS x_status, replace(replace(coalesce(min(product), ''), '&', ''), '<', '') AS x_product, replace(replace(coalesce(min(component), ''), '&', ''), '<', '') AS x_component, strftime(min(loaded_at), '%Y-%m-%d') AS x_date FROM validbugs WHERE bug IS NOT NULL GROUP BY bug"


def _pages(s, d):
    no = lambda c: F.regexp_replace(F.coalesce(F.min(c), F.lit("")), "[&<]", "")
    b = table(s, d, "validbugs").where("bug IS NOT NULL").groupBy("bug").agg(F.coalesce(F.min("status"), F.lit("")).alias("x_status"), no("product").alias("x_product"), no("component").alias("x_component"), F.date_format(F.min("loaded_at"), "yyyy-MM-dd").alias("x_date"))
    return b.select("bug", F.expr(_PAGE).alias("html"))


def _sizes(s, d):
    p = table(s, d, "region").select(F.col("r_regionkey").cast("int").alias("k"))
    rows = [(k, lsh.signature_size(k + 2), lsh.size_for_error(1 / (k + 2)), round(lsh.error_for_size((k + 2) ** 2), 9)) for k in (r["k"] for r in p.collect())]
    return s.createDataFrame(rows, "k int, length long, size long, error double")


def _graph(s, d):
    root = scratch(s)
    _, _, nodes, edges = _lined(s, d)
    H.save_graph(nodes, edges, root)
    nodes, edges = H.load_graph(s, root)
    return nodes.groupBy("file_id", "type").agg(F.count(F.lit(1)).alias("n")).join(edges.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_edges")), "file_id", "left")


QUERIES = {
    "arff_scan": lambda s, d: arff.read(s, _arff_files(s, d, "bugs")),
    "arff_binary_subset": lambda s, d: arff.read(s, _arff_files(s, d, "bugs"), [0, 4], True),
    "log_dump_scan": _log_dump,
    "store_scan": _store,
    "metric_files_scan": _metric_files,
    "blame_records_scan": _blame_records,
    "csv_sink": _csv,
    "component_list": lambda s, d: read_components(s, _component_csv(s, d)),
    "bug_pages": lambda s, d: pages.extract_bugs(_pages(s, d)).select("bug", "state", "status", "product", "component", "reportDateText", "version"),
    "patch_rows": lambda s, d: pages.extract_patches(_pages(s, d)).select("bug", "patchId", "patchText", "patchSize", "patchDateText", "patchRowType"),
    "push_dates": lambda s, d: _pages(s, d).select("bug", pages.push_date_text(F.col("html")).alias("pushed")),
    "renamed_files": lambda s, d: table(s, d, "part").select("p_partkey", F.explode(pages.renamed(F.concat(F.lit("rename from a/"), F.col("p_partkey").cast("string"), F.lit("\nrename to b/"), F.col("p_brand"), F.lit("\nother\n")))).alias("r")).select("p_partkey", "r.copy_from", "r.copy_to"),
    "source_at": lambda s, d: H.source_at(_texts(s, d).withColumn("file", F.col("file_id")), F.col("file"), 2).select("file", F.md5("text").alias("digest")),
    "utf8_texts": lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(H.utf8(F.encode("text", "UTF-8"))).alias("digest")),
    "signature_sizes": _sizes,
    "graph_store": _graph,
}


def _component_csv(s, d):
    root = scratch(s)
    table(s, d, "part").groupBy(F.col("p_type").alias("component")).agg(F.count(F.lit(1)).alias("n")).write.option("header", True).csv(root)
    return root


_A = f"WITH {INST} SELECT project || '-' || (row_number() OVER (PARTITION BY project ORDER BY id) - 1) AS id, project, "
ORACLES = {
    "arff_scan": _A + ", ".join(f"{f} AS f{k}" for k, f in enumerate(FEATURES)) + ", bugs::DOUBLE AS label FROM inst",
    "arff_binary_subset": _A + f"{FEATURES[0]} AS f0, {FEATURES[4]} AS f4, (bugs > 0)::INT::DOUBLE AS label FROM inst",
    "log_dump_scan": "SELECT id AS locid, cid, regexp_replace(author, '[:;\n]', ' ', 'g') AS author, '3:' || cid AS parents, 'a/' || id || '.c b.h' AS files, epoch(date_trunc('minute', seen))::BIGINT AS seconds FROM (SELECT id, min(cid) AS cid, min(loaded_at) AS seen, min(author) AS author FROM repolog GROUP BY 1) WHERE cid IS NOT NULL AND author IS NOT NULL",
    "store_scan": "SELECT upper(status) AS status, 2 * count(*) AS n, count(DISTINCT bug) AS n_bugs FROM validbugs WHERE component IS NOT NULL GROUP BY 1 UNION ALL SELECT 'people', count(*), count(DISTINCT username) FROM users",
    "metric_files_scan": "SELECT p_partkey AS fid, p_size::BIGINT AS rev_index, p_brand AS rev_id, p_size::DOUBLE || ',' || CASE WHEN p_size % 3 = 0 THEN 0.0::DOUBLE ELSE round(p_retailprice, 2) END || ',0.0' AS metrics FROM part",
    "blame_records_scan": f"WITH {_BL}, b AS (SELECT DISTINCT blamer, blamed, bug, file_id, kind, component FROM blames) SELECT file_id::VARCHAR AS file_id, 'src/x.c' AS file_name, kind AS blamed_code, count(*) AS n, count(DISTINCT blamed) AS n_revs, 4 * count(*) AS idx, 17 * count(*) AS lines FROM b GROUP BY 2, 1, 3",
    "csv_sink": f"WITH {INST} SELECT " + ", ".join(f"round({f}, 4) AS {f}" for f in [*FEATURES, "label"]) + " FROM inst",
    "component_list": "SELECT DISTINCT p_type AS component FROM part WHERE p_type IS NOT NULL",
    "bug_pages": f"SELECT bug, 1 AS state, trim(x_status) AS status, trim(x_product) AS product, trim(x_component) AS component, x_date AS \"reportDateText\", '' AS version FROM ({_PAGED})",
    "patch_rows": f"SELECT bug, bug AS \"patchId\", 'fix ' || bug AS \"patchText\", (bug % 90) || ' KB' AS \"patchSize\", x_date AS \"patchDateText\", 'patch' AS \"patchRowType\" FROM ({_PAGED})",
    "push_dates": f"SELECT bug, x_date AS pushed FROM ({_PAGED})",
    "renamed_files": "SELECT p_partkey, 'a/' || p_partkey AS copy_from, 'b/' || p_brand AS copy_to FROM part",
    "source_at": f"WITH {_REV} SELECT doc_id AS file, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM rev r WHERE rev_idx = (SELECT max(rev_idx) FROM rev x WHERE x.doc_id = r.doc_id AND x.rev_idx <= 2) GROUP BY 1",
    "utf8_texts": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL",
    "signature_sizes": "SELECT r_regionkey::INT AS k, ((r_regionkey + 2) * (ceil(ln(1.0 / (r_regionkey + 2)) / ln(0.5)) + 1))::BIGINT AS length, ((r_regionkey + 2) * (r_regionkey + 2))::BIGINT AS size, round(1.0 / (r_regionkey + 2), 9) AS error FROM region",
    "graph_store": f"{_LINES} SELECT n.f AS file_id, base || CASE WHEN gone THEN ';-' ELSE '' END AS type, count(*) AS n, max(ne) AS n_edges FROM n LEFT JOIN (SELECT f, count(*) AS ne FROM e GROUP BY 1) q USING (f) GROUP BY 1, 2",
}
