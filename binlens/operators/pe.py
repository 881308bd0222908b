"""PE header and section decoding as Catalyst expressions.

The decoder reads fields at fixed little-endian offsets (public PE/COFF layout) from the head
of each file, in parallel per row; nothing leaves the JVM. Output is long form
``(sample_id, source_rank, field, value)``; malformed files and clipped sections become reject rows
with a reason. Each file is decoded once, into one narrow row without its content; headers,
sections and rejects are all derived from that row.
Merge order (later wins): optional header 1, NT headers 2, file header 3, DOS header 4,
sections 5. In the file header, fields after ``TimeDateStamp`` are left out unless
``full_headers=True``; the stamp itself is reported as its UTC year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binlens.functions.bytes import ascii_field, hex_field, le_uint, starts_with_bytes
from binlens.functions.text import escape_linebreaks, year_from_epoch_seconds
from binlens.session import cut_lineage

DOS_BYTES = 64

# PE/COFF header layouts. (field, offset, width, kind); kind u = unsigned LE,
# h = hex block, s = byte string. Optional-header entries give PE32 and PE32+ offsets/widths.
DOS_FIELDS = [
    ("e_magic", 0, 2, "u"), ("e_cblp", 2, 2, "u"), ("e_cp", 4, 2, "u"), ("e_crlc", 6, 2, "u"),
    ("e_cparhdr", 8, 2, "u"), ("e_minalloc", 10, 2, "u"), ("e_maxalloc", 12, 2, "u"), ("e_ss", 14, 2, "u"),
    ("e_sp", 16, 2, "u"), ("e_csum", 18, 2, "u"), ("e_ip", 20, 2, "u"), ("e_cs", 22, 2, "u"),
    ("e_lfarlc", 24, 2, "u"), ("e_ovno", 26, 2, "u"), ("e_res", 28, 8, "h"), ("e_oemid", 36, 2, "u"),
    ("e_oeminfo", 38, 2, "u"), ("e_res2", 40, 20, "h"), ("e_lfanew", 60, 4, "u"),
]
NT_FIELDS = [("Signature", 0, 4, "u")]
FILE_FIELDS = [("Machine", 0, 2, "u"), ("NumberOfSections", 2, 2, "u"), ("TimeDateStamp", 4, 4, "y")]
FILE_FIELDS_REST = [("PointerToSymbolTable", 8, 4, "u"), ("NumberOfSymbols", 12, 4, "u"),
                    ("SizeOfOptionalHeader", 16, 2, "u"), ("Characteristics", 18, 2, "u")]
# (field, pe32 offset, pe32 width, pe32+ offset, pe32+ width); None = absent in that format
OPTIONAL_FIELDS = [
    ("Magic", 0, 2, 0, 2), ("MajorLinkerVersion", 2, 1, 2, 1), ("MinorLinkerVersion", 3, 1, 3, 1),
    ("SizeOfCode", 4, 4, 4, 4), ("SizeOfInitializedData", 8, 4, 8, 4), ("SizeOfUninitializedData", 12, 4, 12, 4),
    ("AddressOfEntryPoint", 16, 4, 16, 4), ("BaseOfCode", 20, 4, 20, 4), ("BaseOfData", 24, 4, None, None),
    ("ImageBase", 28, 4, 24, 8), ("SectionAlignment", 32, 4, 32, 4), ("FileAlignment", 36, 4, 36, 4),
    ("MajorOperatingSystemVersion", 40, 2, 40, 2), ("MinorOperatingSystemVersion", 42, 2, 42, 2),
    ("MajorImageVersion", 44, 2, 44, 2), ("MinorImageVersion", 46, 2, 46, 2),
    ("MajorSubsystemVersion", 48, 2, 48, 2), ("MinorSubsystemVersion", 50, 2, 50, 2),
    ("Reserved1", 52, 4, 52, 4), ("SizeOfImage", 56, 4, 56, 4), ("SizeOfHeaders", 60, 4, 60, 4),
    ("CheckSum", 64, 4, 64, 4), ("Subsystem", 68, 2, 68, 2), ("DllCharacteristics", 70, 2, 70, 2),
    ("SizeOfStackReserve", 72, 4, 72, 8), ("SizeOfStackCommit", 76, 4, 80, 8),
    ("SizeOfHeapReserve", 80, 4, 88, 8), ("SizeOfHeapCommit", 84, 4, 96, 8),
    ("LoaderFlags", 88, 4, 104, 4), ("NumberOfRvaAndSizes", 92, 4, 108, 4),
]
SECTION_FIELDS = [
    ("Name", 0, 8, "s"), ("Misc", 8, 4, "u"), ("Misc_PhysicalAddress", 8, 4, "u"), ("Misc_VirtualSize", 8, 4, "u"),
    ("VirtualAddress", 12, 4, "u"), ("SizeOfRawData", 16, 4, "u"), ("PointerToRawData", 20, 4, "u"),
    ("PointerToRelocations", 24, 4, "u"), ("PointerToLinenumbers", 28, 4, "u"),
    ("NumberOfRelocations", 32, 2, "u"), ("NumberOfLinenumbers", 34, 2, "u"), ("Characteristics", 36, 4, "u"),
]
PE32_PLUS = 0x20B
RANK = {"optional": 1, "nt": 2, "file": 3, "dos": 4, "section": 5}


def _value(buf: Column, off, width: int, kind: str) -> Column:
    if kind == "h":
        return hex_field(buf, off, width)
    if kind == "s":
        return ascii_field(buf, off, width)
    v = le_uint(buf, off, width)
    if kind == "y":
        return year_from_epoch_seconds(v).cast("string")
    return v.cast("string")


def _located(samples: DataFrame, content: str) -> DataFrame:
    """Adds the DOS head, e_lfanew, and status (ok / truncated / bad_magic / bad_signature)."""
    head = F.substring(F.col(content), 1, DOS_BYTES)
    df = samples.withColumns({"_head": head, "_len": F.octet_length(F.col(content))})
    df = df.withColumn("_lfanew", le_uint(F.col("_head"), 60, 4))
    status = (F.when(F.col("_len") < DOS_BYTES, F.lit("truncated"))
              .when(~starts_with_bytes(F.col("_head"), 0, "4D5A"), F.lit("bad_magic"))
              .when(F.col("_lfanew") + 24 > F.col("_len"), F.lit("truncated"))
              .when(~starts_with_bytes(F.col(content), F.col("_lfanew"), "50450000"), F.lit("bad_signature"))
              .otherwise(F.lit("ok")))
    return df.withColumn("status", status)


def parse(samples: DataFrame, id_col: str = "sample_id", content: str = "content", full_headers: bool = False,
          keep: tuple = ()) -> DataFrame:
    """One row per file: id, the ``keep`` columns, ``status``, ``headers`` (array of source_rank, field,
    value), ``sections`` (array of ordinal, values in the order of SECTION_FIELDS) and ``clipped`` (ordinals
    of the section headers that end past the file). Contents are read here and nowhere else."""
    loc = _located(samples.select(id_col, *keep, content), content)
    # header bytes from e_lfanew on (NT signature, file header, optional header)
    loc = loc.withColumn("_nt", F.when(F.col("status") == "ok", F.col(content).substr(F.col("_lfanew") + 1, F.lit(24 + 240))))
    opt = F.col("_nt").substr(F.lit(25), F.lit(240))
    is64 = le_uint(opt, 0, 2) == PE32_PLUS
    entries = []
    for name, off, w, kind in DOS_FIELDS:
        entries.append((RANK["dos"], name, _value(F.col("_head"), off, w, kind)))
    for name, off, w, kind in NT_FIELDS:
        entries.append((RANK["nt"], name, _value(F.col("_nt"), off, w, kind)))
    for name, off, w, kind in FILE_FIELDS + (FILE_FIELDS_REST if full_headers else []):
        entries.append((RANK["file"], name, _value(F.col("_nt"), 4 + off, w, kind)))
    for name, o32, w32, o64, w64 in OPTIONAL_FIELDS:
        v32 = _value(opt, o32, w32, "u")
        v64 = _value(opt, o64, w64, "u") if o64 is not None else F.lit(None).cast("string")
        entries.append((RANK["optional"], name, F.when(is64, v64).otherwise(v32)))
    headers = F.array(*[F.struct(F.lit(r).alias("source_rank"), F.lit(n).alias("field"), v.alias("value"))
                        for r, n, v in entries])
    n_sec = F.coalesce(le_uint(F.col("_nt"), 6, 2), F.lit(0))
    base = F.col("_lfanew") + 24 + F.coalesce(le_uint(F.col("_nt"), 20, 2), F.lit(0))
    whole = F.greatest(F.lit(0).cast("long"), F.least(n_sec, F.floor((F.col("_len") - base) / F.lit(40))))
    # the section table as one slice: its size is bounded by the 16-bit section count
    loc = loc.withColumns({"_n": n_sec, "_whole": whole}).withColumn(
        "_table", F.col(content).substr((base + 1).cast("int"), (F.col("_whole") * 40).cast("int")))

    def section(i):
        at = i * 40
        return F.struct(i.cast("int").alias("ordinal"),
                        F.array(*[_value(F.col("_table"), at + off, w, kind) for _, off, w, kind in SECTION_FIELDS]).alias("values"))

    def span(lo, hi):       # sequence(0, -1) would count down
        return F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))

    ok = F.col("status") == "ok"
    return loc.select(id_col, *keep, "status", F.when(ok, headers).alias("headers"),
                      F.when(ok, F.transform(span(F.lit(0).cast("long"), F.col("_whole")), section)).alias("sections"),
                      F.when(ok, span(F.col("_whole"), F.col("_n"))).alias("clipped"))


def header_fields(parsed: DataFrame, id_col: str = "sample_id") -> DataFrame:
    return parsed.select(id_col, F.inline("headers")).filter(F.col("value").isNotNull())


def section_fields(parsed: DataFrame, id_col: str = "sample_id") -> DataFrame:
    names = F.array(*[F.lit(n) for n, *_ in SECTION_FIELDS])
    one = parsed.select(id_col, F.explode("sections").alias("s"))
    return one.select(id_col, F.col("s.ordinal").alias("ordinal"), F.explode(F.arrays_zip(
        names.alias("field"), F.col("s.values").alias("value"))).alias("f")).select(id_col, "ordinal", "f.field", "f.value")


def reject_rows(parsed: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, reason): one row per malformed file, and one per section header that ends past its file."""
    bad = parsed.filter(F.col("status") != "ok").select(id_col, F.col("status").alias("reason"))
    clipped = parsed.select(id_col, F.explode("clipped").alias("i"))
    return bad.unionByName(clipped.select(id_col, F.concat(F.lit("clipped_section_"), F.col("i").cast("string")).alias("reason")))


def decode(samples: DataFrame, id_col: str = "sample_id", content: str = "content",
           full_headers: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (header_fields, section_fields, rejects), all from one pass over the contents.

    header_fields: (sample_id, source_rank, field, value string)
    section_fields: (sample_id, ordinal, field, value string)
    rejects: (sample_id, reason)
    """
    parsed = cut_lineage(parse(samples, id_col, content, full_headers))
    return header_fields(parsed, id_col), section_fields(parsed, id_col), reject_rows(parsed, id_col)


def flatten_sections(sections: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """(id, source_rank=5, field + ordinal, value)."""
    return sections.select(id_col, F.lit(RANK["section"]).alias("source_rank"),
                           F.concat(F.col("field"), F.col("ordinal").cast("string")).alias("field"), "value")


def merge_last_wins(fields: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One value per (id, field): the one from the highest source rank (grouped ``max_by``; on a
    rank tie the larger value, so the result does not depend on row order)."""
    return fields.groupBy(id_col, "field").agg(F.max_by("value", F.struct("source_rank", "value")).alias("value"))


def to_wide(long_df: DataFrame, fields: list[str], id_col: str = "sample_id", fill="0") -> DataFrame:
    """Pivot (one shuffle on id) over an explicit field list (no extra job to find the values);
    missing cells are filled with ``fill`` as the raw extraction does. A repeated (id, field)
    keeps its largest value, independent of row order."""
    wide = long_df.groupBy(id_col).pivot("field", fields).agg(F.max("value"))
    return wide.fillna(fill, subset=fields) if fill is not None else wide


def raw_feature_table(samples: DataFrame, id_col: str = "sample_id", name_col: str = "sample_name",
                      label_col: str = "label", fields: list[str] | None = None, min_sections: int = 31):
    """Whole extraction: parse once, flatten, merge, pivot, fill, escape, label. Returns
    (table, rejects). The field list defaults to every header field plus ``min_sections`` numbered
    section groups, or as many as the longest section table has (one aggregate): none is left out."""
    return parsed_feature_table(cut_lineage(parse(samples, id_col, keep=(name_col, label_col))), id_col, name_col,
                                label_col, fields, min_sections)


def parsed_feature_table(parsed: DataFrame, id_col: str = "sample_id", name_col: str = "sample_name",
                         label_col: str = "label", fields: list[str] | None = None, min_sections: int = 31):
    """``raw_feature_table`` of rows that ``parse`` made; they are read more than once, so write or persist them."""
    long_df = merge_last_wins(header_fields(parsed, id_col).unionByName(
        flatten_sections(section_fields(parsed, id_col), id_col)), id_col)
    if fields is None:
        most = parsed.agg(F.max(F.size("sections"))).first()[0] or 0
        fields = ([f for f, *_ in OPTIONAL_FIELDS] + [f for f, *_ in NT_FIELDS] + [f for f, *_ in FILE_FIELDS]
                  + [f for f, *_ in DOS_FIELDS]
                  + [f"{f}{i}" for i in range(max(min_sections, most)) for f, *_ in SECTION_FIELDS])
    wide = to_wide(long_df, fields, id_col)
    if "e_res2" in wide.columns:
        wide = wide.withColumn("e_res2", escape_linebreaks(F.col("e_res2")))
    return parsed.select(id_col, name_col, label_col).join(wide, id_col), reject_rows(parsed, id_col)
