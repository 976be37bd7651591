"""Matrices exported as text."""

import gzip
from pathlib import Path

from tessera.plans import registry, solving

SF = "/root/testdata/sf0.001"


def test_triplets_are_packed_and_whole(spark, monkeypatch, tmp_path):
    """Entries were written as plain text, at some thirty bytes each."""
    monkeypatch.setattr(solving, "shared_folder", lambda spark: str(tmp_path / "out"))
    got = {r.file: r for r in registry.queries()["snk15"](spark, SF).collect()}
    for k in ("a", "m"):
        files = [f for f in Path(tmp_path / "out" / k).iterdir() if f.name.startswith("part-")]
        assert files and all(f.name.endswith(".csv.gz") for f in files)
        texts = [gzip.decompress(f.read_bytes()).decode().splitlines() for f in files]
        assert {t[0] for t in texts} == {"row_idx\tcol_idx\tvalue"}
        rows = [line.split("\t") for t in texts for line in t[1:]]
        assert len(rows) == got[k].rows and abs(sum(float(r[2]) for r in rows) - got[k].total) < 1e-3
