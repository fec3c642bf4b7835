"""Readers and writers of sequence files: GenBank, FASTA, SnapGene, codon-usage JSON, order CSV.

Files are read whole, one row per file (``wholetext`` or ``binaryFile``), and parsed per row.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_PART = _struct(start=T.IntegerType(), end=T.IntegerType(), strand=T.IntegerType())
_FEATURE = _struct(kind=T.StringType(), start=T.IntegerType(), end=T.IntegerType(), strand=T.IntegerType(), parts=T.ArrayType(_PART), qualifiers=T.MapType(T.StringType(), T.ArrayType(T.StringType())))
#: A sequence file's record; intervals that wrap end past the length.
RECORD = _struct(name=T.StringType(), sequence=T.StringType(), topology=T.StringType(), features=T.ArrayType(_FEATURE), notes=T.ArrayType(T.StringType()))


def parse_location(text: str, length: int, circular: bool) -> list[tuple[int, int, int]]:
    """GenBank location to 0-based parts (start, end, strand); ``join`` across the origin becomes one wrapping part.

    Fuzzy positions are an error.
    """
    if re.search(r"[<>^]|one-of|order", text):
        raise ValueError(f"inexact location {text}")
    strand = 1
    body = text.replace(" ", "")
    while m := re.fullmatch(r"(complement|join)\((.*)\)", body):
        strand = -strand if m[1] == "complement" else strand
        body = m[2]
    parts = []
    for piece in body.split(","):
        m = re.fullmatch(r"(complement\()?(\d+)(?:\.\.(\d+))?\)?", piece)
        if not m:
            raise ValueError(f"location {text} is not understood")
        a, b = int(m[2]) - 1, int(m[3] or m[2])
        if not 0 <= a < b <= length:
            raise ValueError(f"location {text} is outside the record")
        parts.append((a, b, -strand if m[1] else strand))
    if circular and len(parts) == 2 and parts[0][1] == length and parts[1][0] == 0:
        parts = [(parts[0][0], length + parts[1][1], parts[0][2])]
    return parts


def format_location(start: int, end: int, strand: int, length: int) -> str:
    """0-based interval to a GenBank location; one that wraps is split again."""
    body = f"{start + 1}..{end}" if end <= length else f"join({start + 1}..{length},1..{end - length})"
    return f"complement({body})" if strand < 0 else body


def parse_genbank(text: str) -> dict:
    """One record; features that cannot be placed are dropped with a note, a missing topology is an error."""
    head = re.search(r"^LOCUS\s+(\S+)\s+(\d+) bp(.*)$", text, re.M)
    if not head:
        raise ValueError("no LOCUS line")
    shape = re.search(r"\b(circular|linear)\b", head[3])
    if not shape:
        raise ValueError("the record does not say whether it is circular")
    origin = text.split("\nORIGIN", 1)[1].split("\n//", 1)[0] if "\nORIGIN" in text else ""
    sequence = re.sub(r"[^A-Za-z]", "", origin.split("\n", 1)[1] if "\n" in origin else "").upper()
    if re.search("[^ACGT]", sequence):
        raise ValueError("the sequence has letters other than ACGT")
    circular = shape[1] == "circular"
    features, notes = [], []
    table = re.search(r"^FEATURES.*?\n(.*?)(?=^ORIGIN|^CONTIG|^//)", text, re.M | re.S)
    for block in re.split(r"\n(?=     \S)", table[1].rstrip("\n")) if table else []:
        m = re.match(r"     (\S+)\s+(.*?)(?=\n\s+/|\Z)", block, re.S)
        if not m:
            continue
        place = re.sub(r"\s+", "", m[2])
        quals: dict[str, list[str]] = {}
        for q in re.finditer(r"\n\s+/(\w+)(?:=(\"(?:[^\"]|\"\")*\"|[^\n]*))?", block):
            value = re.sub(r"\n\s+", " ", (q[2] or "").strip().strip('"')).replace('""', '"')
            quals.setdefault(q[1], []).append(value)
        try:
            parts = parse_location(place, len(sequence), circular)
        except ValueError as why:
            notes.append(f"{m[1]}: {why}")
            continue
        features.append({"kind": m[1], "start": min(p[0] for p in parts), "end": max(p[1] for p in parts), "strand": parts[0][2], "parts": [dict(zip(("start", "end", "strand"), p, strict=True)) for p in parts], "qualifiers": quals})
    return {"name": head[1], "sequence": sequence, "topology": shape[1], "features": features, "notes": notes}


def format_genbank(name: str, sequence: str, topology: str, features: list[dict]) -> str:
    """A GenBank record of a sequence and features (``kind, start, end, strand, qualifiers``)."""
    n = len(sequence)
    lines = [f"LOCUS       {name:<16} {n} bp    DNA     {topology:<8} SYN", "FEATURES             Location/Qualifiers"]
    for f in features:
        lines.append(f"     {f['kind']:<16}{format_location(f['start'], f['end'], f['strand'], n)}")
        for key, values in sorted((f.get("qualifiers") or {}).items()):
            lines += [" " * 21 + f'/{key}="{v}"'.replace('""', '"') for v in values]
    lines.append("ORIGIN")
    for at in range(0, n, 60):
        row = sequence[at : at + 60].lower()
        lines.append(f"{at + 1:>9} " + " ".join(row[k : k + 10] for k in range(0, len(row), 10)))
    return "\n".join([*lines, "//", ""])


def parse_snapgene(data: bytes) -> dict:
    """The sequence packet of a SnapGene file: topology flag and bases.  Other packets are left out with a note."""
    at, out = 0, None
    while at + 5 <= len(data):
        kind, size = struct.unpack_from(">BI", data, at)
        body = data[at + 5 : at + 5 + size]
        if kind == 0 and out is None:
            sequence = body[1:].decode("ascii").upper()
            if re.search("[^ACGT]", sequence):
                raise ValueError("the sequence has letters other than ACGT")
            out = {"name": "", "sequence": sequence, "topology": "circular" if body[0] & 1 else "linear", "features": [], "notes": []}
        at += 5 + size
    if out is None:
        raise ValueError("no sequence packet")
    return out


def parse_fasta(text: str, topology: str) -> list[dict]:
    """Records of a FASTA text; a FASTA file does not say its topology, so it must be given."""
    if topology not in ("linear", "circular"):
        raise ValueError("FASTA needs a topology")
    out = []
    for part in re.split(r"^>", text, flags=re.M)[1 if text.lstrip().startswith(">") else 0 :]:
        head, _, body = part.partition("\n") if text.lstrip().startswith(">") else ("", "", part)
        sequence = re.sub(r"\s+", "", body).upper()
        if re.search("[^ACGT]", sequence):
            raise ValueError("the sequence has letters other than ACGT")
        out.append({"name": head.split()[0] if head.split() else "", "sequence": sequence, "topology": topology, "features": [], "notes": []})
    return out


def _records(df: DataFrame, column: str, parse) -> DataFrame:
    """``path`` and the parsed record's fields; a file that cannot be read has its error in ``error``."""
    schema = T.StructType([T.StructField("records", T.ArrayType(RECORD)), T.StructField("error", T.StringType())])

    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            try:
                found = parse(v)
                rows.append((found if isinstance(found, list) else [found], None))
            except ValueError as why:
                rows.append(([], str(why)))
        return pd.DataFrame(rows, columns=["records", "error"])

    parsed = df.withColumn("p", F.pandas_udf(run, schema)(F.col(column)))
    return parsed.select("path", "p.error", F.explode_outer("p.records").alias("r")).select("path", "error", "r.*")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return _records(files, "value", parse_genbank)


def read_fasta(spark: SparkSession, path: str, topology: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return _records(files, "value", lambda text: parse_fasta(text, topology))


def read_snapgene(spark: SparkSession, path: str) -> DataFrame:
    return _records(spark.read.format("binaryFile").load(path).select("path", "content"), "content", parse_snapgene)


#: Reader by file suffix: fixed values.
SUFFIXES = {"gb": "genbank", "gbk": "genbank", "genbank": "genbank", "ape": "genbank", "dna": "snapgene", "fa": "fasta", "fasta": "fasta", "fna": "fasta", "seq": "fasta", "txt": "fasta"}


def read_vector(spark: SparkSession, path: str, topology: str | None = None) -> DataFrame:
    """Reader chosen by suffix; FASTA needs ``topology``."""
    kind = SUFFIXES.get(path.rsplit(".", 1)[-1].lower())
    if kind == "genbank":
        return read_genbank(spark, path)
    if kind == "snapgene":
        return read_snapgene(spark, path)
    if kind == "fasta":
        return read_fasta(spark, path, topology or "")
    raise ValueError(f"no reader for {path}")


def read_codon_usage(spark: SparkSession, path: str) -> DataFrame:
    """``reference_set, codon, w`` from JSON files with a ``w`` map; provenance stays in the file."""
    schema = "w map<string,double>"
    files = spark.read.schema(schema).json(path, multiLine=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("reference_set"), F.explode("w").alias("codon", "w"))
    return files


def write_genbank(df: DataFrame, path: str) -> None:
    """``name, sequence, topology, features`` rows as one text file of records per task."""

    def render(name: pd.Series, sequence: pd.Series, topology: pd.Series, features: pd.Series) -> pd.Series:
        return pd.Series([format_genbank(n, s, t, [dict(f, qualifiers={k: list(v) for k, v in (f.get("qualifiers") or {}).items()}) for f in fs]) for n, s, t, fs in zip(name, sequence, topology, features, strict=True)])

    df.select(F.pandas_udf(render, "string")("name", "sequence", "topology", "features").alias("value")).write.mode("overwrite").text(path)


def write_orders(orders: DataFrame, path: str) -> None:
    """Order sheet ``Name,Sequence``."""
    orders.select(F.col("name").alias("Name"), F.col("sequence").alias("Sequence")).write.mode("overwrite").csv(path, header=True)
