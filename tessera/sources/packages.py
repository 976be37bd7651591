"""Packages: archives of datasets, in three forms, and what an import does with them.

An archive has a manifest that lists its entries (``manifest``); or datasets in folders named by their tables
(``folder``: table/id_version.json); or one list for each table (``legacy``: tidas/table.json). An archive is made and read
by one task, as its format is one file; many archives are made and read side by side.
"""

from __future__ import annotations

import io
import json
import re
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .artifacts import digest

#: The tables of a package, and the order in which its datasets are inserted.
TABLES = ("contacts", "sources", "unitgroups", "flowproperties", "flows", "processes", "lifecyclemodels")
INSERTED = ("contacts", "sources", "unitgroups", "flowproperties", "flows", "lifecyclemodels", "processes")
#: The object that a table's documents hold.
ROOTS = {"contacts": "contactDataSet", "sources": "sourceDataSet", "unitgroups": "unitGroupDataSet", "flowproperties": "flowPropertyDataSet", "flows": "flowDataSet", "processes": "processDataSet", "lifecyclemodels": "lifeCycleModelDataSet"}
LEGACY = "tidas"
ARCHIVE = "package string, entries long, sha256 string, bytes binary"
ENTRY = "package string, form string, table string, id string, version string, model_id string, json string"
_PATH = re.compile(r"([a-z]+)/([0-9a-f-]{36})_([^/]+)\.json")


def normal(version: str) -> str:
    """NN.NN.NNN of three parts of digits; other texts stay."""
    parts = version.strip().split(".")
    return ".".join(p.zfill(3 if i == 2 else 2) for i, p in enumerate(parts)) if len(parts) == 3 and all(p.isdigit() for p in parts) else version.strip()


def with_version(table: str, doc: dict, version: str) -> dict:
    """The document with its version where a publication states it; objects on the way are made if they are not there."""
    root = ROOTS[table]
    inner = doc.get(root) if isinstance(doc.get(root), dict) else {}
    admin = inner.get("administrativeInformation") if isinstance(inner.get("administrativeInformation"), dict) else {}
    publication = admin.get("publicationAndOwnership") if isinstance(admin.get("publicationAndOwnership"), dict) else {}
    return {**doc, root: {**inner, "administrativeInformation": {**admin, "publicationAndOwnership": {**publication, "common:dataSetVersion": normal(version)}}}}


def table_order(table: Column, order: tuple[str, ...] = TABLES) -> Column:
    """The place of a table in an order; unknown ones come last."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, t in enumerate(order) for x in (t, i))), table), F.lit(len(order)))


def archives(entries: DataFrame, form: str = "manifest") -> DataFrame:
    """One archive for each package of entries (package, table, id, version, model_id, json)."""
    if form not in ("manifest", "folder", "legacy"):
        raise ValueError(f"unknown form {form}")

    def f(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["table", "id", "version", "model_id", "json"]).to_pylist(), key=lambda r: (TABLES.index(r["table"]), r["id"], r["version"]))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:

            def add(name: str, text: str) -> None:
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)

            path = lambda r: f"{r['table']}/{r['id']}_{r['version']}.json"
            if form == "manifest":
                counts = {t: sum(r["table"] == t for r in rows) for t in TABLES}
                add("manifest.json", json.dumps({"entries": [{"table": r["table"], "id": r["id"], "version": r["version"], "file_path": path(r), "model_id": r["model_id"]} for r in rows], "counts": counts, "total_count": len(rows)}))
            if form == "legacy":
                for t in TABLES:
                    add(f"{LEGACY}/{t}.json", json.dumps([{"id": r["id"], "version": r["version"], "model_id": r["model_id"], "json_ordered": json.loads(r["json"])} for r in rows if r["table"] == t]))
            else:
                for r in rows:
                    add(path(r), r["json"])
        data = out.getvalue()
        return pa.table({"package": table["package"].slice(0, 1).combine_chunks(), "entries": [len(rows)], "sha256": [digest(data)], "bytes": pa.array([data], pa.binary())})

    return entries.groupBy("package").applyInArrow(f, ARCHIVE)


def opened(data: bytes) -> tuple[str, list[tuple]]:
    """The form of an archive and its entries (table, id, version, model id, document), each once, in the first form that has any."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        manifest = {}
        if "manifest.json" in names:
            try:
                manifest = json.loads(z.read("manifest.json"))
            except ValueError:
                manifest = {}
        listed = {e["file_path"]: e for e in manifest.get("entries", [])}
        if missing := [p for p in listed if p not in names]:
            raise ValueError(f"the package lacks {missing[0]}")
        found, form = [(e["table"], e["id"], e["version"], e.get("model_id"), json.loads(z.read(p))) for p, e in listed.items()], "manifest"
        if not found:
            hits = [(m, n) for n in z.namelist() if (m := _PATH.fullmatch(n)) and m[1] in TABLES and normal(m[3])]
            found, form = [(m[1], m[2], normal(m[3]), None, json.loads(z.read(n))) for m, n in hits], "folder"
        if not found:
            form = "legacy"
            for t in TABLES:
                if f"{LEGACY}/{t}.json" in names:
                    items = json.loads(z.read(f"{LEGACY}/{t}.json"))
                    if not isinstance(items, list):
                        raise ValueError(f"the list of {t} is none")
                    found += [(t, x["id"], normal(x["version"]), x.get("model_id"), x.get("json_ordered", {})) for x in items if isinstance(x, dict) and x.get("id") and normal(str(x.get("version") or ""))]
    once = {(t, i, normal(v)): (t, i, normal(v), m, with_version(t, d, v)) for t, i, v, m, d in found}
    return form, [once[k] for k in sorted(once)]


def entries(packages: DataFrame) -> DataFrame:
    """The datasets of archives (package, sha256, bytes); one whose hash differs fails the read."""

    def f(batches):
        for b in batches:
            for row in b.to_pylist():
                if digest(row["bytes"]) != row["sha256"]:
                    raise ValueError(f"{row['package']} differs from its hash")
                form, found = opened(row["bytes"])
                columns = list(zip(*((row["package"], form, t, i, v, m, json.dumps(d, sort_keys=True)) for t, i, v, m, d in found), strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [c.split()[0] for c in ENTRY.split(", ")])

    return packages.select("package", "sha256", "bytes").mapInArrow(f, ENTRY)


def with_models(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Processes without a model get the one whose parts (model_id, id, version) name them."""
    of = parts.groupBy(F.lit("processes").alias("table"), "id", "version").agg(F.min("model_id").alias("parent"))
    return rows.join(of, ["table", "id", "version"], "left").withColumn("model_id", F.coalesce("model_id", "parent")).drop("parent")


def preflight(rows: DataFrame, existing: DataFrame, errors: int, open_states: list[int]) -> tuple[DataFrame, DataFrame]:
    """What an import does: the report (one row), and the entries that it inserts.

    Errors of validation stop it first; then entries that public data has already are left out; and any that a user's own data
    has rejects all of it.
    """
    have = existing.groupBy("table", "id", "version").agg(F.max("state").alias("state"))
    met = rows.select("table", "id", "version").distinct().join(have, ["table", "id", "version"], "left")
    public = F.coalesce(F.col("state").isin(open_states), F.lit(False))
    counts = met.agg(F.count("*").alias("total"), F.count_if(public).alias("filtered"), F.count_if(F.col("state").isNotNull() & ~public).alias("conflicts"))
    code = F.when(F.lit(errors > 0), "VALIDATION_FAILED").when(F.col("conflicts") > 0, "USER_DATA_CONFLICT").otherwise("IMPORTED")
    if errors == 0 and not rows.limit(1).count():
        raise ValueError("the package holds no supported dataset")
    report = counts.withColumn("code", code).withColumn("imported", F.when(F.col("code") == "IMPORTED", F.col("total") - F.col("filtered")).otherwise(0).cast("long"))
    allowed = F.broadcast(report.where("code = 'IMPORTED'").select("code"))
    kept = met.where(~public).crossJoin(allowed).withColumn("place", table_order(F.col("table"), INSERTED)).drop("code", "state")
    return report, kept
