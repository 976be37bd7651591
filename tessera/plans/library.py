"""Queries on documents that refer to one another, on packages of them and on characterisation factors.

The library is made from the supplied tables: parts are flows (each fifth in two versions), suppliers are processes, regions
are contacts and sources, the remainders of suppliers by seven are models.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..sources import artifacts, factors, packages, references
from ..sources.network import Network
from ..sources.tables import shared_folder, written
from .registry import query

_ID = "printf('%08x-0000-4000-8000-%012x', {}, {})"
V1, V2, OLD = "01.00.000", "01.01.000", "00.09.000"

#: SQL of the library: documents (category, id, version) and references as the documents state them.
LIBRARY = f"""part_flow AS (SELECT p_partkey AS k, '{V1}' AS version FROM part UNION ALL SELECT p_partkey, '{V2}' FROM part WHERE p_partkey % 5 = 0),
ex AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem WHERE l_partkey % 50 = l_suppkey % 50),
docs AS (SELECT 'flows' AS category, {_ID.format(2, 'k')} AS id, version FROM part_flow UNION ALL SELECT 'processes', {_ID.format(1, 's_suppkey')}, '{V1}' FROM supplier
  UNION ALL SELECT 'contacts', {_ID.format(6, 'r_regionkey')}, '{V1}' FROM region UNION ALL SELECT 'sources', {_ID.format(5, 'r_regionkey')}, '{V1}' FROM region WHERE r_regionkey < 3),
refs AS (SELECT 'flows' AS category, {_ID.format(2, 'k')} AS id, version, 'common:referenceToDataSetFormat' AS reference_key, 'sources' AS target_category, {_ID.format(5, 'k % 4')} AS target_id, '{V1}' AS requested, 'support_document' AS role, NULL::VARCHAR AS issue FROM part_flow
  UNION ALL SELECT 'flows', {_ID.format(2, 'k')}, version, 'common:referenceToPrecedingDataSetVersion', 'flows', {_ID.format(2, 'k')}, CASE WHEN version = '{V2}' THEN '{V1}' ELSE '{OLD}' END, 'support_document', NULL::VARCHAR FROM part_flow WHERE k % 4 = 0 OR version = '{V2}'
  UNION ALL SELECT 'processes', {_ID.format(1, 's')}, '{V1}', 'referenceToFlowDataSet', 'flows', {_ID.format(2, 'k')}, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '01.02.000' ELSE '{V1}' END, 'process_exchange_flow', NULL::VARCHAR FROM ex
  UNION ALL SELECT 'processes', {_ID.format(1, 's_suppkey')}, '{V1}', 'common:referenceToOwnershipOfDataSet', 'contacts', CASE WHEN s_suppkey % 5 <> 0 THEN {_ID.format(6, 's_suppkey % 7')} END, CASE WHEN s_suppkey % 3 <> 0 THEN '{V1}' END, 'support_document', CASE WHEN s_suppkey % 5 = 0 THEN 'reference_object_id_missing' END FROM supplier),
latest AS (SELECT category, id, max(version) AS last FROM docs GROUP BY 1, 2),
res AS (SELECT r.*, CASE WHEN r.requested IS NOT NULL THEN d.version ELSE l.last END AS found FROM refs r LEFT JOIN docs d ON d.category = r.target_category AND d.id = r.target_id AND d.version = r.requested LEFT JOIN latest l ON l.category = r.target_category AND l.id = r.target_id WHERE issue IS NULL),
node AS (SELECT category || ':' || id || ':' || version AS src, target_category || ':' || target_id || ':' || found AS dst FROM res WHERE found IS NOT NULL)"""


def _ref(kind: str, id_: Column | None, version: Column | None) -> Column:
    fields = [F.lit(f"{kind} data set").alias("@type"), F.lit("../x.json").alias("@uri")]
    fields += [id_.alias("@refObjectId")] if id_ is not None else []
    fields += [version.alias("@version")] if version is not None else []
    return F.struct(*fields)


def _objects(*pairs: tuple[str, Column]) -> Column:
    return F.struct(*(c.alias(name) for name, c in pairs))


def _docs(n: Network) -> DataFrame:
    """(category, id, version, json) of the library; fields that are null are not in the JSON."""
    k = F.col("k")
    versions = F.when(k % 5 == 0, F.array(F.lit(V1), F.lit(V2))).otherwise(F.array(F.lit(V1)))
    flows = n.table("part").select(F.col("p_partkey").alias("k"), "p_name", "p_size").withColumn("version", F.explode(versions))
    before = F.when(F.col("version") == V2, V1).otherwise(OLD)
    preceding = F.when((k % 4 == 0) | (F.col("version") == V2), _ref("flow", fn.uuid(2, k), before))
    name = _objects(("baseName", F.array(F.struct(F.lit("en").alias("@xml:lang"), F.col("p_name").alias("#text")))))
    flow = _objects(("flowDataSet", _objects(("flowInformation", _objects(("dataSetInformation", _objects(("name", name))))), ("administrativeInformation", _objects(("common:referenceToDataSetFormat", _ref("source", fn.uuid(5, k % 4), F.lit(V1))), ("common:referenceToPrecedingDataSetVersion", preceding))))))
    out = flows.select(F.lit("flows").alias("category"), fn.uuid(2, k).alias("id"), "version", F.to_json(flow).alias("json"))
    version = F.when(k % 6 == 0, None).when(k % 6 == 1, "01.02.000").otherwise(V1)
    ex = n.table("lineitem").where("l_partkey % 50 = l_suppkey % 50").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("k")).distinct()
    ex = ex.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("k", _objects(("referenceToFlowDataSet", _ref("flow", fn.uuid(2, k), version))).alias("x")))).alias("xs"))
    s = F.col("s_suppkey")
    owner = _ref("contact", F.when(s % 5 != 0, fn.uuid(6, s % 7)), F.when(s % 3 != 0, V1))
    process = _objects(("processDataSet", _objects(("exchanges", _objects(("exchange", F.transform("xs", lambda x: x["x"])))), ("administrativeInformation", _objects(("common:referenceToOwnershipOfDataSet", owner))))))
    rows = n.table("supplier").select("s_suppkey").join(ex, F.col("s_suppkey") == F.col("s"), "left")
    out = out.unionByName(rows.select(F.lit("processes").alias("category"), fn.uuid(1, s).alias("id"), F.lit(V1).alias("version"), F.to_json(process).alias("json")))
    r = F.col("r_regionkey")
    region = n.table("region")
    out = out.unionByName(region.select(F.lit("contacts").alias("category"), fn.uuid(6, r).alias("id"), F.lit(V1).alias("version"), F.to_json(_objects(("contactDataSet", F.struct("r_name")))).alias("json")))
    return out.unionByName(region.where("r_regionkey < 3").select(F.lit("sources").alias("category"), fn.uuid(5, r).alias("id"), F.lit(V1).alias("version"), F.to_json(_objects(("sourceDataSet", F.struct("r_name")))).alias("json")))


def _refs(n: Network) -> DataFrame:
    return written(references.extracted(_docs(n)))


def _node(category: str, id_: str, version: str) -> Column:
    return F.concat_ws(":", category, id_, version)


def _edges(refs: DataFrame, docs: DataFrame, latest: bool = True) -> DataFrame:
    found = references.resolved(refs, docs, latest).where("found is not null")
    return found.select(_node("category", "id", "version").alias("src"), _node("target_category", "target_id", "found").alias("dst"))


@query("gr10", "SELECT category, reference_key, target_category, role, issue, count(*) AS found, count(requested) AS explicit FROM refs GROUP BY ALL", LIBRARY)
def gr10(n):
    """References in all documents: their keys, targets, roles and issues, and how many state a version."""
    return _refs(n).groupBy("category", "reference_key", "target_category", "role", "issue").agg(F.count("*").alias("found"), F.count("requested").alias("explicit"))


@query("jn10", "SELECT category, reference_key, count(*) AS found FROM refs GROUP BY 1, 2", LIBRARY)
def jn10(n):
    """Objects at any depth under a key that names a reference."""
    return _refs(n).where(F.lower("reference_key").contains("referenceto")).groupBy("category", "reference_key").agg(F.count("*").alias("found"))


_CLASS = "CASE WHEN role = 'process_exchange_flow' THEN 'exchange_flow' WHEN reference_key LIKE '%PrecedingDataSetVersion' THEN 'lineage' ELSE 'administrative_support' END"


@query("gr11", f"SELECT kind, CASE kind WHEN 'exchange_flow' THEN 'validate_exchange_axis' WHEN 'lineage' THEN 'record_evidence' ELSE CASE WHEN issue IS NULL THEN 'fetch_optional_support' ELSE 'record_evidence' END END AS action, count(*) AS found FROM (SELECT {_CLASS} AS kind, issue FROM refs) GROUP BY 1, 2", LIBRARY)
def gr11(n):
    """References by role and by what a calculation does with them; a malformed one of those it does not need is kept as evidence."""
    rows = _refs(n).withColumn("kind", fn.reference_role(F.col("category"), F.col("target_category"), F.col("json_path")))
    evidence = F.col("issue").isNotNull() & F.col("kind").isin("administrative_support", "lineage", "model_composition")
    action = F.when(evidence, "record_evidence").otherwise(fn.reference_action(F.col("kind"), "review_submit"))
    return rows.groupBy("kind", action.alias("action")).agg(F.count("*").alias("found"))


_LINES = f"lines AS (SELECT DISTINCT concat_ws('|', category, id, version, '$.' || CASE category WHEN 'flows' THEN 'flowDataSet' ELSE 'processDataSet' END || '.administrativeInformation.' || reference_key, target_category, target_id, coalesce(requested, ''), {_CLASS}) AS line FROM refs WHERE issue IS NULL AND role = 'support_document'), parts AS (SELECT substr(sha256(line), 1, 2) AS part, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS k FROM lines GROUP BY 1)"


@query("gr12", f"SELECT sum(k)::BIGINT AS \"references\", sha256(string_agg(h, '' ORDER BY part)) AS sha256, (SELECT string_agg(line, chr(10) ORDER BY line) FROM (SELECT line FROM lines ORDER BY line LIMIT 8)) AS samples, sum(k) > 8 AS truncated FROM parts", f"{LIBRARY}, {_LINES}")
def gr12(n):
    """Evidence references: how many, their hash, eight of them."""
    rows = _refs(n).where("issue is null").withColumn("role", fn.reference_role(F.col("category"), F.col("target_category"), F.col("json_path")))
    return references.provenance(rows.where(F.col("role").isin("lineage", "administrative_support", "model_composition")))


_REACH = "reach AS (SELECT category || ':' || id || ':' || version AS node FROM docs WHERE category = 'processes' UNION SELECT dst FROM reach JOIN node ON src = node)"


@query("gr07", "SELECT split_part(node, ':', 1) AS category, count(*) AS documents FROM reach GROUP BY 1", f"RECURSIVE {LIBRARY}, {_REACH}")
def gr07(n):
    """Documents that the processes' package needs: exact versions, or the latest where none is asked for, down to the last."""
    docs = written(_docs(n))
    roots = docs.where("category = 'processes'").select(_node("category", "id", "version").alias("node"))
    found = references.closure(_edges(_refs(n), docs), roots)
    return found.groupBy(F.split_part("node", F.lit(":"), F.lit(1)).alias("category")).agg(F.count("*").alias("documents"))


_EXACT = "enode AS (SELECT category || ':' || id || ':' || version AS src, target_category || ':' || target_id || ':' || found AS dst FROM res WHERE requested IS NOT NULL AND found IS NOT NULL), reach AS (SELECT category || ':' || id || ':' || version AS node FROM docs WHERE category = 'processes' UNION SELECT dst FROM reach JOIN enode ON src = node), bad AS (SELECT category || ':' || id || ':' || version AS src, CASE WHEN issue IS NOT NULL THEN issue WHEN requested IS NULL THEN 'version_omitted' ELSE 'exact_identity_missing' END AS code, target_category, coalesce(target_id, '') AS target FROM refs r WHERE issue IS NOT NULL OR requested IS NULL OR NOT EXISTS (SELECT 1 FROM docs d WHERE d.category = r.target_category AND d.id = r.target_id AND d.version = r.requested))"


def _certificate(n: Network) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Roots, exact edges, documents reached and issues in them: an exact version is never replaced, an omitted one is rejected."""
    docs, refs = written(_docs(n)), _refs(n)
    roots = docs.where("category = 'processes'").select(_node("category", "id", "version").alias("node"))
    edges = written(_edges(refs, docs, latest=False))
    reached = references.closure(edges, roots)
    missing = references.resolved(refs, docs, latest=False).where("found is null").select(_node("category", "id", "version").alias("src"), F.when(F.col("requested").isNull(), "version_omitted").otherwise("exact_identity_missing").alias("code"), "target_category", "target_id")
    broken = refs.where("issue is not null").select(_node("category", "id", "version").alias("src"), F.col("issue").alias("code"), "target_category", "target_id")
    issues = missing.unionByName(broken).join(reached.select(F.col("node").alias("src")), "src", "left_semi")
    return roots, edges, reached, written(issues)


@query("gr08", "SELECT code, count(*) AS occurrences, count(DISTINCT (target_category, target)) AS targets, (SELECT count(*) FROM reach) AS reached FROM bad WHERE src IN (SELECT node FROM reach) GROUP BY 1", f"RECURSIVE {LIBRARY}, {_EXACT}")
def gr08(n):
    """A certificate's closure: all issues in the documents reached, none of which stops it."""
    _, _, reached, issues = _certificate(n)
    total = reached.agg(F.count("*").alias("reached"))
    by = issues.groupBy("code").agg(F.count("*").alias("occurrences"), F.countDistinct("target_category", F.coalesce("target_id", F.lit(""))).alias("targets"))
    return by.crossJoin(F.broadcast(total))


@query("gr09", "SELECT code, count(DISTINCT root) AS roots FROM (SELECT p.node AS root, p.at FROM walk p) w JOIN bad ON bad.src = w.at GROUP BY 1", f"RECURSIVE {LIBRARY}, {_EXACT}, walk AS (SELECT category || ':' || id || ':' || version AS node, category || ':' || id || ':' || version AS at FROM docs WHERE category = 'processes' UNION SELECT w.node, e.dst FROM walk w JOIN enode e ON e.src = w.at)")
def gr09(n):
    """Roots that each kind of issue affects: all from which a document that has it is reached."""
    roots, edges, _, issues = _certificate(n)
    hit = references.affected(edges, issues.select(F.col("src").alias("node")), roots)
    return issues.select("src", "code").distinct().join(hit, F.col("src") == F.col("source")).groupBy("code").agg(F.countDistinct("root").alias("roots"))


@query("jn12", "SELECT DISTINCT target_category, target_id, found AS version FROM res WHERE found IS NOT NULL", LIBRARY)
def jn12(n):
    """Documents that references ask for: the versions named, and the latest where none is."""
    return references.resolved(_refs(n), _docs(n)).where("found is not null").select("target_category", "target_id", F.col("found").alias("version")).distinct()


@query("jn01", f"SELECT s AS process, k AS flow, CASE WHEN k % 6 IN (0, 1) THEN last ELSE '{V1}' END AS version, CASE WHEN k % 6 IN (0, 1) THEN 'latest' ELSE 'exact' END AS how FROM ex JOIN (SELECT k, max(version) AS last FROM part_flow GROUP BY 1) USING (k)", LIBRARY)
def jn01(n):
    """Exchanges with their flow: the version named if it is there, else the latest."""
    from ..operators import versions

    k = F.col("k")
    ex = n.table("lineitem").where("l_partkey % 50 = l_suppkey % 50").select(F.col("l_suppkey").alias("process"), F.col("l_partkey").alias("k")).distinct()
    asked = ex.select("process", F.col("k").alias("id"), F.when(k % 6 == 0, None).when(k % 6 == 1, "01.02.000").otherwise(V1).alias("version"))
    flows = n.table("part").select(F.col("p_partkey").alias("id"), F.explode(F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(V1), F.lit(V2))).otherwise(F.array(F.lit(V1)))).alias("version"))
    found = versions.exact_or_latest(asked.select("id", "version").distinct(), flows).select(F.col("id").alias("flow"), F.col("version").alias("v"), "resolved", "how")
    same = (F.col("id") == F.col("flow")) & F.col("version").eqNullSafe(F.col("v"))
    return asked.join(found, same).select("process", "flow", F.col("resolved").alias("version"), "how")


_AUDIT = "audit AS (SELECT r.*, d.id IS NOT NULL AS id_there, e.id IS NOT NULL AS exact_there FROM refs r LEFT JOIN (SELECT DISTINCT category, id FROM docs) d ON d.category = r.target_category AND d.id = r.target_id LEFT JOIN docs e ON e.category = r.target_category AND e.id = r.target_id AND e.version = r.requested)"
_EIGHT = "count(*) AS occurrences, 0::BIGINT AS empty_objects, count(*) FILTER (WHERE target_id IS NULL) AS missing_ids, 0::BIGINT AS invalid_ids, 0::BIGINT AS unresolved_types, count(*) FILTER (WHERE target_id IS NOT NULL AND NOT id_there) AS missing_targets, count(*) FILTER (WHERE id_there AND requested IS NOT NULL AND NOT exact_there) AS missing_versions, 0::BIGINT AS invalid_versions, count(*) FILTER (WHERE id_there AND (requested IS NULL OR exact_there)) AS resolved"


def _audited(n: Network) -> DataFrame:
    docs = written(_docs(n))
    ids = docs.select(F.col("category").alias("target_category"), F.col("id").alias("target_id")).distinct().withColumn("i", F.lit(True))
    exact = docs.select(F.col("category").alias("target_category"), F.col("id").alias("target_id"), F.col("version").alias("requested")).distinct().withColumn("e", F.lit(True))
    rows = _refs(n).join(ids, ["target_category", "target_id"], "left").join(exact, ["target_category", "target_id", "requested"], "left")
    return rows.withColumn("there", F.col("i").isNotNull()).withColumn("exact", F.col("e").isNotNull())


def _eight() -> list[Column]:
    id_, there, exact, asked = F.col("target_id"), F.col("there"), F.col("exact"), F.col("requested")
    good = fn.is_uuid(id_)
    return [
        F.count("*").alias("occurrences"),
        F.count_if("empty").alias("empty_objects"),
        F.count_if(id_.isNull()).alias("missing_ids"),
        F.count_if(id_.isNotNull() & ~good).alias("invalid_ids"),
        F.count_if(F.col("target_category").isNull()).alias("unresolved_types"),
        F.count_if(good & F.col("target_category").isNotNull() & ~there).alias("missing_targets"),
        F.count_if(there & asked.isNotNull() & fn.is_version(asked) & ~exact).alias("missing_versions"),
        F.count_if(asked.isNotNull() & ~fn.is_version(asked)).alias("invalid_versions"),
        F.count_if(there & (asked.isNull() | exact)).alias("resolved"),
    ]


@query("ag11", f"SELECT category, reference_key, target_category, {_EIGHT} FROM audit GROUP BY 1, 2, 3", f"{LIBRARY}, {_AUDIT}")
def ag11(n):
    """References by source, key and target under eight conditions."""
    return _audited(n).groupBy("category", "reference_key", "target_category").agg(*_eight())


@query("dq02", f"SELECT 'references' AS section, NULL AS category, {_EIGHT} FROM audit UNION ALL SELECT 'documents', category, count(*), 0, 0, 0, 0, 0, 0, 0, 0 FROM docs GROUP BY 2", f"{LIBRARY}, {_AUDIT}")
def dq02(n):
    """The audit of references: totals of all, and the documents of each category with those over the limit of 64 MiB."""
    total = _audited(n).agg(F.lit("references").alias("section"), F.lit(None).cast("string").alias("category"), *_eight())
    over = F.count_if(F.octet_length("json") > 64 << 20)
    zero = [F.lit(0).cast("long").alias(c) for c in ("missing_ids", "invalid_ids", "unresolved_types", "missing_targets", "missing_versions", "invalid_versions", "resolved")]
    sizes = _docs(n).groupBy("category").agg(F.count("*").alias("occurrences"), over.alias("empty_objects")).select(F.lit("documents").alias("section"), "category", "occurrences", "empty_objects", *zero)
    return total.unionByName(sizes)


@query("src06", "SELECT category, target_category, count(*) AS found FROM refs WHERE issue IS NULL GROUP BY 1, 2", LIBRARY)
def src06(n):
    """A source closure stored as compressed artifacts and decoded."""
    rows = _refs(n).where("issue is null").select(F.col("category"), "id", "target_category", "target_id", F.pmod(F.crc32("id"), F.lit(16)).alias("shard"))
    path = shared_folder(n.spark)
    artifacts.encoded(rows, "shard", "source-closure", size=1).write.parquet(path)
    return artifacts.decoded(n.spark.read.parquet(path), "source-closure", "category string, id string, target_category string, target_id string, shard bigint").groupBy("category", "target_category").agg(F.count("*").alias("found"))


# Packages: processes by the remainder of their number by seven, with the flows and contacts of the library


def _entries(n: Network) -> DataFrame:
    s = F.col("s_suppkey")
    process = n.table("supplier").select((s % 7).cast("string").alias("package"), F.lit("processes").alias("table"), fn.uuid(1, s).alias("id"), F.lit("1.0.0").alias("version"), F.lit(None).cast("string").alias("model_id"), F.to_json(F.struct(F.struct("s_name").alias("processDataSet"))).alias("json"))
    contact = n.table("region").select(F.lit("0").alias("package"), F.lit("contacts").alias("table"), fn.uuid(6, F.col("r_regionkey")).alias("id"), F.lit(V1).alias("version"), F.lit(None).cast("string").alias("model_id"), F.to_json(F.struct(F.struct("r_name").alias("contactDataSet"))).alias("json"))
    model = n.table("supplier").select((s % 7).alias("m")).distinct().select(F.col("m").cast("string").alias("package"), F.lit("lifecyclemodels").alias("table"), fn.uuid(7, F.col("m")).alias("id"), F.lit(V1).alias("version"), F.lit(None).cast("string").alias("model_id"), F.to_json(F.struct(F.struct("m").alias("lifeCycleModelDataSet"))).alias("json"))
    return process.unionByName(contact).unionByName(model)


_ENTRIES = f"ent AS (SELECT (s_suppkey % 7)::VARCHAR AS package, 'processes' AS \"table\", {_ID.format(1, 's_suppkey')} AS id, '{V1}' AS version, s_suppkey AS s FROM supplier UNION ALL SELECT '0', 'contacts', {_ID.format(6, 'r_regionkey')}, '{V1}', NULL FROM region UNION ALL SELECT DISTINCT (s_suppkey % 7)::VARCHAR, 'lifecyclemodels', {_ID.format(7, 's_suppkey % 7')}, '{V1}', NULL FROM supplier)"


@query("src10", "SELECT form, package, \"table\", id, version FROM ent CROSS JOIN (VALUES ('manifest'), ('folder'), ('legacy')) AS t(form)", _ENTRIES)
def src10(n):
    """Archives in their three forms, read: with a manifest, by folders, as lists."""
    rows = written(_entries(n))
    parts = [packages.entries(written(packages.archives(rows, form))).select("form", "package", "table", "id", "version") for form in ("manifest", "folder", "legacy")]
    return reduce(DataFrame.unionByName, parts)


@query("snk11", "SELECT package, count(*) AS entries FROM ent GROUP BY 1", _ENTRIES)
def snk11(n):
    """Archives written, one for each package, with as many datasets as its manifest counts."""
    path = shared_folder(n.spark)
    packages.archives(_entries(n)).write.parquet(path)
    read = packages.entries(n.spark.read.parquet(path)).groupBy("package").agg(F.count("*").alias("read"))
    return n.spark.read.parquet(path).select("package", "entries").join(read, "package").where("entries = read").drop("read")


@query("jn14", f"SELECT id, {_ID.format(7, 's % 7')} AS model_id FROM ent WHERE \"table\" = 'processes'", _ENTRIES)
def jn14(n):
    """Processes with the model whose parts name them."""
    s = F.col("s_suppkey")
    parts = n.table("supplier").select(fn.uuid(7, s % 7).alias("model_id"), fn.uuid(1, s).alias("id"), F.lit("1.0.0").alias("version"))
    return packages.with_models(_entries(n), parts).where("table = 'processes'").select("id", "model_id")


_HAVE = f"have AS (SELECT {_ID.format(1, 's_suppkey')} AS id, CASE WHEN s_suppkey % 4 = 0 THEN 100 ELSE 0 END AS state FROM supplier WHERE s_suppkey % 2 = 0)"


@query("op08", "SELECT * FROM (SELECT 'plain' AS case_, 'IMPORTED' AS code, count(*) AS total, 0::BIGINT AS filtered, 0::BIGINT AS conflicts, count(*) AS imported FROM ent UNION ALL SELECT 'public', 'IMPORTED', count(*), count(*) FILTER (WHERE s % 4 = 0), 0, count(*) - count(*) FILTER (WHERE s % 4 = 0) FROM ent UNION ALL SELECT 'own', 'USER_DATA_CONFLICT', count(*), count(*) FILTER (WHERE s % 4 = 0), count(*) FILTER (WHERE s % 4 = 2), 0 FROM ent UNION ALL SELECT 'invalid', 'VALIDATION_FAILED', count(*), 0, 0, 0 FROM ent)", _ENTRIES)
def op08(n):
    """Imports: into nothing, beside public data, against one's own data, and with errors of validation."""
    rows, s = written(_entries(n)), F.col("s_suppkey")
    have = n.table("supplier").where("s_suppkey % 2 = 0").select(F.lit("processes").alias("table"), fn.uuid(1, s).alias("id"), F.lit("1.0.0").alias("version"), F.when(s % 4 == 0, 100).otherwise(0).alias("state"))
    cases = (("plain", have.limit(0), 0), ("public", have.where("state = 100"), 0), ("own", have, 0), ("invalid", have.limit(0), 3))
    parts = [packages.preflight(rows, there, errors, [100])[0].select(F.lit(name).alias("case_"), "code", "total", "filtered", "conflicts", "imported") for name, there, errors in cases]
    return reduce(DataFrame.unionByName, parts)


@query("snk12", "SELECT \"table\", CASE \"table\" WHEN 'contacts' THEN 0 WHEN 'processes' THEN 6 ELSE 5 END AS place, count(*) AS rows FROM ent WHERE s IS NULL OR s % 4 <> 0 GROUP BY 1", _ENTRIES)
def snk12(n):
    """Datasets that an import inserts, table by table in the order of their dependence."""
    s = F.col("s_suppkey")
    have = n.table("supplier").where("s_suppkey % 4 = 0").select(F.lit("processes").alias("table"), fn.uuid(1, s).alias("id"), F.lit("1.0.0").alias("version"), F.lit(100).alias("state"))
    _, kept = packages.preflight(_entries(n), have, 0, [100])
    base = shared_folder(n.spark)
    kept = written(kept)
    for t in packages.INSERTED:  # a fixed number of tables
        kept.where(F.col("table") == t).write.mode("append").parquet(f"{base}/{t}")
    return reduce(DataFrame.unionByName, [n.spark.read.parquet(f"{base}/{t}") for t in packages.INSERTED]).groupBy("table", "place").agg(F.count("*").alias("rows"))


@query("op09", f"SELECT id, '{V1}' AS version, '{V1}' AS stated FROM ent WHERE \"table\" = 'processes'", _ENTRIES)
def op09(n):
    """Datasets as an import takes them: versions in full, and stated where a publication states them."""
    read = packages.entries(packages.archives(_entries(n), "folder")).where("table = 'processes'")
    return read.select("id", "version", F.get_json_object("json", "$.processDataSet.administrativeInformation.publicationAndOwnership['common:dataSetVersion']").alias("stated"))


@query("st03", "SELECT row_number() OVER (ORDER BY CASE \"table\" WHEN 'contacts' THEN 0 WHEN 'processes' THEN 5 ELSE 6 END, id, version) - 1 AS place, \"table\", id FROM ent", _ENTRIES)
def st03(n):
    """Datasets in the order of their tables, ids and versions."""
    from ..sources.tables import numbered

    rows = _entries(n).select("table", "id", "version", packages.table_order(F.col("table")).alias("t"))
    return numbered(rows, ["t", "id", "version"], "place").select("place", "table", "id")


# Factors: parts are flows, brands are methods


def _index(n: Network) -> DataFrame:
    p = F.col("p_partkey")
    entry = F.struct(F.concat(F.lit("m"), (p % 3).cast("string")).alias("key"), F.col("p_size").cast("string").alias("value"))
    other = F.struct(F.lit("m3").alias("key"), F.col("p_size").alias("value").cast("string").alias("value"))
    factor = F.when(p % 2 == 0, F.to_json(F.array(entry, other, other))).otherwise(F.to_json(entry))
    direction = F.when(p % 4 < 2, "Input").otherwise("Output")
    record = F.concat(F.lit('"'), fn.uuid(2, p), F.lit(":"), F.upper(direction), F.lit('":{"flow_id":"'), fn.uuid(2, p), F.lit('","flow_version":"01.00.000","direction":"'), direction, F.lit('","factor":'), factor, F.lit("}"))
    rows = n.table("part").select((p % 8).alias("part"), p.alias("p"), record.alias("r"))
    return rows.groupBy("part").agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "r"))), lambda x: x["r"]), ","), F.lit("}")).alias("json")).select("json")


_FACTOR = "fac AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 4 < 2 THEN 'INPUT' ELSE 'OUTPUT' END AS direction, 'm' || (p_partkey % 3) AS method, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'INPUT' ELSE 'OUTPUT' END, 'm3', p_size FROM part CROSS JOIN range(2) WHERE p_partkey % 2 = 0)"


@query("src09", f"SELECT {_ID.format(2, 'p')} AS flow_id, direction, method, value FROM fac", _FACTOR)
def src09(n):
    """Factors from an index, written and read compressed, whose records hold one or a list of them."""
    path = shared_folder(n.spark)
    _index(n).write.option("compression", "gzip").text(path)
    return factors.parsed(factors.read(n.spark, path))


_CARD = "card AS (SELECT method, count(*) AS entries, count(DISTINCT (p, direction)) AS distinct_keys, count(*) - count(DISTINCT (p, direction)) AS duplicates FROM fac GROUP BY 1)"


@query("src08", "SELECT * FROM card", f"{_FACTOR}, {_CARD}")
def src08(n):
    """A bundle of factors whose files and cardinalities are those of its manifest."""
    path = shared_folder(n.spark)
    _index(n).write.option("compression", "gzip").text(path)
    described = written(artifacts.files(n.spark, path, limit=128 << 20))
    found = written(factors.parsed(n.spark.read.text(path), "value"))
    manifest = written(factors.cardinality(found))
    return factors.verify(found, manifest, artifacts.files(n.spark, path), described)


@query("ag21", "SELECT * FROM card UNION ALL SELECT 'all', sum(entries)::BIGINT, sum(distinct_keys)::BIGINT, sum(duplicates)::BIGINT FROM card", f"{_FACTOR}, {_CARD}")
def ag21(n):
    """Factor entries, distinct keys and duplicates of each method and of all."""
    by = factors.cardinality(factors.parsed(_index(n)))
    return by.unionByName(by.agg(F.lit("all").alias("method"), *(F.sum(c).alias(c) for c in ("entries", "distinct_keys", "duplicates"))))


@query("ag20", ", x AS (SELECT l_partkey AS p, CASE l_returnflag WHEN 'R' THEN 'INPUT' WHEN 'A' THEN 'OUTPUT' ELSE 'NONE' END AS direction, bool_and(l_linenumber <> 7) AS valid FROM lineitem GROUP BY 1, 2), u AS (SELECT count(*) FILTER (WHERE direction <> 'NONE' AND valid) AS usable, count(*) FILTER (WHERE direction <> 'NONE' AND NOT valid) AS invalid, count(*) FILTER (WHERE direction = 'NONE') AS unsupported FROM x), m AS (SELECT method, count(*) AS matched FROM (SELECT DISTINCT method, p, direction FROM fac) JOIN x USING (p, direction) WHERE valid GROUP BY 1) SELECT method, matched, usable - matched AS unmatched, invalid, unsupported AS unsupported_direction FROM m CROSS JOIN u", _FACTOR)
def ag20(n):
    """Exchange keys by method: with a factor, without, without a valid amount, in a direction that factors do not know."""
    flag = F.col("l_returnflag")
    x = n.table("lineitem").select(fn.uuid(2, F.col("l_partkey")).alias("flow_id"), F.when(flag == "R", "INPUT").when(flag == "A", "OUTPUT").otherwise("NONE").alias("direction"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("amount"))
    return factors.coverage(factors.parsed(_index(n)), x)


@query("flt10", f"SELECT {_ID.format(2, 'p')} AS flow_id, count(*) AS factors FROM fac WHERE p IN (SELECT k FROM ex) GROUP BY 1", f"{LIBRARY}, {_FACTOR}")
def flt10(n):
    """Factors of flows that exchanges hold; the others say nothing here."""
    axis = n.table("lineitem").where("l_partkey % 50 = l_suppkey % 50").select(fn.uuid(2, F.col("l_partkey")).alias("flow_id")).distinct()
    return factors.parsed(_index(n)).join(axis, "flow_id", "left_semi").groupBy("flow_id").agg(F.count("*").alias("factors"))


def _catalogs(n: Network) -> DataFrame:
    """A catalog of nations by region: three levels, regions without ids."""
    leaf = F.struct(F.col("n_nationkey").cast("string").alias("@id"), F.col("n_name").alias("@name"))
    nations = n.table("nation").groupBy("n_regionkey").agg(F.collect_list(leaf).alias("category"))
    regions = n.table("region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).agg(F.collect_list(F.struct(F.col("r_name").alias("@name"), "category")).alias("category"))
    root = F.struct(F.lit("W").alias("@id"), F.lit("World").alias("@name"), "category")
    return regions.select(F.lit("ISIC").alias("system"), F.to_json(F.struct(F.struct(F.struct(F.lit("Process").alias("@dataType"), root.alias("category")).alias("categories")).alias("CategorySystem"))).alias("json"))


_SLUG = "regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g')"


@query("src14", f"SELECT 1 AS level, 'W' AS ids, 'World' AS names UNION ALL SELECT 2, 'W>' || {_SLUG}, 'World>' || r_name FROM region UNION ALL SELECT 3, 'W>' || {_SLUG} || '>' || n_nationkey, 'World>' || r_name || '>' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey", "")
def src14(n):
    """A catalog's categories with their paths."""
    return factors.catalog(_catalogs(n)).select("level", F.array_join("ids", ">").alias("ids"), F.array_join("names", ">").alias("names"))


@query("jn19", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN NULL ELSE 'World / ' || r_name || ' / ' || n_name END AS found FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey", "")
def jn19(n):
    """Paths looked up in a catalog: by ids, by names, by neither."""
    s = n.table("supplier").join(F.broadcast(n.table("nation")), F.col("n_nationkey") == F.col("s_nationkey")).join(F.broadcast(n.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey") % 3
    ids = F.when(k == 0, F.array(F.lit("W"), F.regexp_replace(F.lower("r_name"), "[^a-z0-9]+", "-"), F.col("n_nationkey").cast("string"))).otherwise(F.array(F.lit("?")))
    names = F.when(k == 1, F.array(F.lit("World"), "r_name", "n_name")).otherwise(F.array(F.lit("?")))
    return factors.lookup(s.select("s_suppkey", ids.alias("i"), names.alias("m")), factors.catalog(_catalogs(n)), "ISIC", "Process", "i", "m").select("s_suppkey", "found")


