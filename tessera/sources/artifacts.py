"""Artifacts: documents and relations as compressed rows with their hashes, line files, workbooks.

An artifact is a row (name, format, version, records, sha256, byte_size, bytes). A relation becomes one row for each of its
chunks, encoded where the chunk lies, so no artifact has to fit the driver; the hash is checked when it is read. ``bytes``
is zstd over canonical JSON: sorted keys, no spaces, no number that JSON lacks.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from xml.sax.saxutils import escape, unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "name string, format string, version int, records long, sha256 string, byte_size long, bytes binary"
#: Rows of a worksheet at most, a fixed value of the format.
SHEET_ROWS = 1_048_576


def canonical(value) -> bytes:
    """JSON by which equal values have equal bytes; a number that is not finite is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def pack(value) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3, write_content_size=True).compress(canonical(value))


def unpack(data: bytes, sha256: str, limit: int = 1 << 30):
    """The value of an artifact whose bytes have that hash and that is at most ``limit`` bytes long when unpacked."""
    import zstandard

    if digest(data) != sha256:
        raise ValueError("an artifact differs from its hash")
    if zstandard.frame_content_size(data) > limit:
        raise ValueError(f"an artifact is longer than {limit} bytes")
    return json.loads(zstandard.ZstdDecompressor().decompress(data, max_output_size=limit))


def document(spark: SparkSession, name: str, kind: str, version: int, value) -> DataFrame:
    """One document, such as a configuration, as an artifact."""
    data = pack({"version": version, "format": kind, "payload": value})
    return spark.createDataFrame([(name, kind, version, 1, digest(data), len(data), bytearray(data))], ROW)


def read_document(artifacts: DataFrame, name: str, kind: str):
    """The payload of the document of that name; another format than ``kind`` is an error."""
    row = artifacts.where(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    value = unpack(bytes(row.bytes), row.sha256)
    if value["format"] != kind:
        raise ValueError(f"{name} is a {value['format']}, not a {kind}")
    return value["payload"]


def encoded(df: DataFrame, key: str, kind: str, version: int = 2, size: int = 256, part: Column | None = None) -> DataFrame:
    """A relation as artifacts, one for each run of ``size`` keys, or for each ``part`` (a number) of such a run if it may be long.

    Version 1 has records with names, version 2 columns.
    """
    columns, parted = df.columns, part is not None

    def f(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in columns), strict=True), key=str)
        body = [dict(zip(columns, r, strict=True)) for r in rows] if version == 1 else {c: [r[i] for r in rows] for i, c in enumerate(columns)}
        data = pack({"version": version, "format": kind, "payload": body})
        name = f"{kind}-{table['chunk'][0].as_py():06}" + (f"-{table['part'][0].as_py():06}" if parted else "")
        return pa.table({"name": [name], "format": [kind], "version": pa.array([version], pa.int32()), "records": [len(rows)], "sha256": [digest(data)], "byte_size": [len(data)], "bytes": pa.array([data], pa.binary())})

    return df.withColumn("chunk", F.floor(F.col(key) / size).cast("long")).withColumn("part", F.lit(0) if part is None else part).groupBy("chunk", "part").applyInArrow(f, ROW)


def decoded(artifacts: DataFrame, kind: str, schema: str) -> DataFrame:
    """The relation of all artifacts of a format, of either version. A hash, format or count that differs fails the read."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def f(batches):
        for b in batches:
            for row in b.to_pylist():
                value = unpack(row["bytes"], row["sha256"])
                if value["format"] != kind or value["version"] != row["version"] or value["version"] not in (1, 2):
                    raise ValueError(f"{row['name']} is not a {kind} of a known version")
                body = value["payload"]
                columns = {c: [r[c] for r in body] for c in arrow.names} if value["version"] == 1 else body
                if len(columns[arrow.names[0]]) != row["records"]:
                    raise ValueError(f"{row['name']} does not hold {row['records']} records")
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in arrow], schema=arrow)

    return artifacts.where(F.col("format") == kind).mapInArrow(f, schema)


def files(spark: SparkSession, path: str, limit: int | None = None, partitions: bool = False) -> DataFrame:
    """(name, length, sha256) of the files below a path, and the columns that its folders name if ``partitions``. A file over ``limit`` bytes is an error, found before any is read."""
    found = spark.read.format("binaryFile").load(path)
    if limit is not None and (large := found.where(F.col("length") > limit).select("path").first()):
        raise ValueError(f"{large.path} is longer than {limit} bytes")
    more = [c for c in found.columns if c not in ("path", "modificationTime", "length", "content")] if partitions else []
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"), *more)


def check_files(found: DataFrame, expected: DataFrame) -> None:
    """Fails unless the files are those of a descriptor (name, length, sha256), no more and no fewer."""
    both = found.withColumn("f", F.lit(True)).join(expected.withColumn("e", F.lit(True)), ["name", "length", "sha256"], "full")
    if bad := both.where("f is null or e is null").select("name").first():
        raise ValueError(f"{bad.name} differs from the descriptor")


def _column(i: int) -> str:
    return chr(65 + i) if i < 26 else _column(i // 26 - 1) + chr(65 + i % 26)


def workbook(sheets: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of sheets (columns, rows) with texts inline and numbers as such; a sheet has ``SHEET_ROWS`` rows at most."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        package = "http://schemas.openxmlformats.org/package/2006"
        n = range(1, len(sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in n)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(name)}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(n, sheets, strict=True))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>")
        for i, (columns, rows) in zip(n, sheets.values(), strict=True):
            if len(rows) >= SHEET_ROWS:
                raise ValueError(f"a sheet has {SHEET_ROWS - 1} rows at most")
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for r, row in enumerate([tuple(columns), *rows], 1):
                    cells = []
                    for c, v in enumerate(row):
                        if isinstance(v, int | float) and not isinstance(v, bool):
                            cells.append(f'<c r="{_column(c)}{r}"><v>{v!r}</v></c>')
                        elif v is not None:
                            cells.append(f'<c r="{_column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                    f.write(f'<row r="{r}">{"".join(cells)}</row>'.encode())
                f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def sheet(data: bytes, i: int = 1) -> list[list]:
    """The rows of a sheet that workbook() has written, as texts and floats; a missing cell is None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        text = z.read(f"xl/worksheets/sheet{i}.xml").decode()
    out = []
    for row in re.findall(r"<row [^>]*>(.*?)</row>", text, re.S):
        cells = {}
        for name, number, words in re.findall(r'<c r="([A-Z]+)\d+"[^>]*>(?:<v>(.*?)</v>|<is><t[^>]*>(.*?)</t></is>)</c>', row, re.S):
            at = 0
            for ch in name:
                at = at * 26 + ord(ch) - 64
            cells[at - 1] = float(number) if number else unescape(words)
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out
