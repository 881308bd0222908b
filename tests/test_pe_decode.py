"""Synthetic PE files (made with struct.pack in a temp folder; never executed)."""

import os
import struct
import tempfile

import pytest

from binlens.operators.dedup import dedup_exact, duplicate_groups
from binlens.operators.pe import decode, raw_feature_table
from binlens.sources.binary import oversize_rejects, samples_from_files, scan_binaries


def make_pe(stamp, sections, machine=0x14C, pe32_plus=False, image_base=0x140000000, count=None, tail=64):
    dos = bytearray(64)
    dos[0:2] = b"MZ"
    dos[28:36] = b"\x01\x02\x03\x04\x05\x06\x07\x08"
    struct.pack_into("<I", dos, 60, 64)
    opt_size = 240 if pe32_plus else 224
    fh = struct.pack("<HHIIIHH", machine, len(sections) if count is None else count, stamp, 0, 0, opt_size, 0x102)
    opt = bytearray(opt_size)
    struct.pack_into("<H", opt, 0, 0x20B if pe32_plus else 0x10B)
    struct.pack_into("<I", opt, 16, 0x1234)  # AddressOfEntryPoint
    if pe32_plus:
        struct.pack_into("<Q", opt, 24, image_base)
    else:
        struct.pack_into("<I", opt, 28, 0x400000)
    secs = b""
    for name, vsize in sections:
        secs += struct.pack("<8sIIIIIIHHI", name, vsize, 0x1000, 0x200, 0x400, 0, 0, 0, 0, 0x60000020)
    return bytes(dos) + b"PE\x00\x00" + fh + bytes(opt) + secs + b"\x00" * tail


@pytest.fixture(scope="module")
def corpus():
    root = tempfile.mkdtemp(prefix="binlens-pe-")
    os.makedirs(f"{root}/benign"); os.makedirs(f"{root}/malware")
    files = {
        "benign/a.exe": make_pe(1595927012, [(b".text", 100), (b".data", 200), (b".rsrc", 300)]),
        "malware/b b.exe": make_pe(0x9F80C0E0, [(b"UPX 0", 5)]),
        "malware/c.exe": make_pe(0x9F80C0E0, [(b"UPX 0", 5)]),
        "benign/zero.exe": make_pe(1595927012, []),
        "benign/short.bin": b"MZ" + b"\x00" * 8,
        "benign/text.txt": b"hello world, this is not an executable at all" * 3,
        "benign/wide.exe": make_pe(1595927012, [(b".text", 7)], pe32_plus=True),
    }
    for k, v in files.items():
        with open(f"{root}/{k}", "wb") as fh:
            fh.write(v)
    return root


def test_decode_headers_sections_rejects(spark, corpus):
    s = scan_binaries(spark, corpus)
    assert s.count() == 7
    h, sec, rej = decode(s)
    # b b.exe and c.exe share content (and so an id); name each id by its smallest file name
    names = {}
    for r in s.select("sample_id", "sample_name").orderBy("sample_name").collect():
        names.setdefault(r["sample_id"], r["sample_name"])
    reasons = {names[r["sample_id"]]: r["reason"] for r in rej.collect()}
    assert reasons == {"short.bin": "truncated", "text.txt": "bad_magic"}
    hv = {(names[r["sample_id"]], r["field"]): r["value"] for r in h.collect()}
    assert hv[("a.exe", "TimeDateStamp")] == "2020"
    assert hv[("a.exe", "Machine")] == str(0x14C)
    assert hv[("a.exe", "NumberOfSections")] == "3"
    assert ("a.exe", "Characteristics") not in hv  # fields after the stamp are not emitted
    assert hv[("a.exe", "e_lfanew")] == "64"
    assert hv[("a.exe", "Signature")] == str(0x4550)
    assert hv[("a.exe", "ImageBase")] == str(0x400000)
    assert hv[("wide.exe", "ImageBase")] == str(0x140000000)
    assert ("wide.exe", "BaseOfData") not in hv
    assert hv[("b b.exe", "TimeDateStamp")] == "2054"  # stamp bytes >= 0x80 decode unsigned
    sv = {(names[r["sample_id"]], r["ordinal"], r["field"]): r["value"] for r in sec.collect()}
    assert sv[("a.exe", 2, "Name")] == ".rsrc"
    assert sv[("a.exe", 1, "Misc_VirtualSize")] == "200"
    assert sv[("b b.exe", 0, "Name")] == "UPX 0"  # space kept
    assert not any(k[0] == "zero.exe" for k in sv)


def test_raw_table_labels_and_dedup(spark, corpus):
    s = scan_binaries(spark, corpus)
    d = dedup_exact(s)
    assert d.count() == 6
    g = duplicate_groups(s).collect()
    assert len(g) == 1 and g[0]["n_copies"] == 2 and g[0]["keep_path"].endswith("b b.exe")
    table, rejects = raw_feature_table(d)
    rows = {r["sample_name"]: r for r in table.collect()}
    assert rows["a.exe"]["label"] == 0 and rows["b b.exe"]["label"] == 1
    assert rows["a.exe"]["Name2"] == ".rsrc" and rows["a.exe"]["Name3"] == "0"
    assert rows["zero.exe"]["Name0"] == "0"
    assert rejects.count() == 2


@pytest.fixture(scope="module")
def odd_corpus():
    root = tempfile.mkdtemp(prefix="binlens-pe-odd-")
    os.makedirs(f"{root}/benign")
    many = [(b".s%d" % i, i) for i in range(40)]
    files = {"forty.exe": make_pe(1595927012, many), "driver.sys": make_pe(1, [(b".a", 1)], pe32_plus=True, image_base=0xFFFFF80000000000),
             "clipped.dll": make_pe(1, [(b".a", 1), (b".b", 2)], count=4, tail=0), "x.pyd": make_pe(2, [(b".p", 1)]),
             "extract-setup.exe": make_pe(3, [(b".q", 1)]), "test.csv": b"own output", "mytest.csv": b"MZ"}
    for k, v in files.items():
        with open(f"{root}/benign/{k}", "wb") as fh:
            fh.write(v)
    return root


def test_nothing_is_lost(spark, odd_corpus):
    s = scan_binaries(spark, odd_corpus)
    table, rejects = raw_feature_table(s)
    rows = {r["sample_name"]: r for r in table.collect()}
    assert set(rows) == {"forty.exe", "driver.sys", "clipped.dll", "x.pyd", "extract-setup.exe"}
    assert rows["forty.exe"]["Name39"] == ".s39" and rows["forty.exe"]["NumberOfSections"] == "40" and "Name40" not in table.columns
    assert rows["driver.sys"]["ImageBase"] == str(0xFFFFF80000000000)
    assert rows["clipped.dll"]["Name1"] == ".b" and rows["clipped.dll"]["Name2"] == "0"
    names = {r["sample_id"]: r["sample_name"] for r in s.collect()}
    assert sorted((names[r["sample_id"]], r["reason"]) for r in rejects.collect()) == [
        ("clipped.dll", "clipped_section_2"), ("clipped.dll", "clipped_section_3"), ("mytest.csv", "truncated")]


def test_giants_are_rejected_by_name(spark, odd_corpus):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(odd_corpus)
    big = oversize_rejects(files, 1000).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["reason"]) for r in big] == [("forty.exe", "too_large")]
    assert samples_from_files(files, max_bytes=1000).count() + len(big) == 6
