"""Files in and out, streams, guards."""

import ast
import json
import re
import struct
from pathlib import Path

import pytest

from strandloom.sources import sequences
from strandloom.streaming import scan as stream

ROOT = Path(__file__).resolve().parents[1]


def test_genbank_round_trip(spark, tmp_path):
    seq = "ACGTTGCA" * 20
    features = [("CDS", 10, 40, 1, {"gene": ["x"]}), ("ori", 150, 170, -1, {"label": ["wraps"]})]
    row = [("vec", seq, "circular", [{"kind": k, "start": a, "end": b, "strand": s, "parts": [], "qualifiers": q} for k, a, b, s, q in features], [])]
    df = spark.createDataFrame(row, sequences.RECORD)
    sequences.write_genbank(df, str(tmp_path / "out"))
    back = sequences.read_genbank(spark, str(tmp_path / "out" / "*.txt")).first()
    assert (back.sequence, back.topology, back.error) == (seq, "circular", None)
    assert [(f.kind, f.start, f.end, f.strand) for f in back.features] == [(k, a, b, s) for k, a, b, s, _ in features]
    assert back.features[0].qualifiers == {"gene": ["x"]}


def test_locations():
    assert sequences.parse_location("complement(join(91..100,1..5))", 100, True) == [(90, 105, -1)]
    assert sequences.format_location(90, 105, -1, 100) == "complement(join(91..100,1..5))"
    assert sequences.parse_location("join(1..3,7..9)", 100, False) == [(0, 3, 1), (6, 9, 1)]
    for bad in ("<1..5", "1^2", "5..200"):
        with pytest.raises(ValueError):
            sequences.parse_location(bad, 100, False)


def test_fasta_snapgene_json_and_orders(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\nTTTT\n")
    got = sequences.read_vector(spark, str(tmp_path / "a.fa"), "linear").collect()
    assert [(r["name"], r.sequence) for r in got] == [("one", "ACGTAC"), ("two", "TTTT")]
    (tmp_path / "bad.fa").write_text(">one\nACGN\n")
    assert sequences.read_vector(spark, str(tmp_path / "bad.fa"), "linear").first().error
    packet = b"\x01" + b"ACGTAC"
    (tmp_path / "v.dna").write_bytes(struct.pack(">BI", 9, 3) + b"xyz" + struct.pack(">BI", 0, len(packet)) + packet)
    row = sequences.read_vector(spark, str(tmp_path / "v.dna")).first()
    assert (row.sequence, row.topology) == ("ACGTAC", "circular")
    (tmp_path / "set.json").write_text(json.dumps({"_provenance": {"x": 1}, "w": {"AAA": 1.0, "AAG": 0.5}}, indent=1))
    assert {(r.reference_set, r.codon, r.w) for r in sequences.read_codon_usage(spark, str(tmp_path / "set.json")).collect()} == {("set", "AAA", 1.0), ("set", "AAG", 0.5)}
    sequences.write_orders(spark.createDataFrame([("d1", "ACGT")], "name string, sequence string"), str(tmp_path / "orders"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "orders"), header=True).collect()] == [("d1", "ACGT")]
    with pytest.raises(ValueError):
        sequences.read_vector(spark, "x.pdf")


def test_stream_equals_batch(spark, sf, tmp_path):
    from strandloom.plans.registry_all import QUERIES

    source = tmp_path / "in"
    source.mkdir()
    (source / "part.parquet").write_bytes(Path(sf, "documents.parquet").read_bytes())
    stream.site_stream(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, QUERIES["motif_scan_six_cutters"].run(spark, sf).collect()))


def test_verifier_and_library_stay_apart():
    tree = ast.parse((ROOT / "strandloom/verify.py").read_text())
    names = {a.name for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names}
    assert not names & {"rules", "solver", "scan", "dna", "operators"}
    for path in (ROOT / "strandloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(import|from)\s.*\bllm\b", path.read_text()), path


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["construct_id", "name", "pos", "strand"]
