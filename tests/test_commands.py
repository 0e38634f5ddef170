import csv

import pytest

from lociweave.cli import main

from . import fixtures as fx


def table(path):
    with open(path) as f:
        return list(csv.DictReader(f, delimiter="\t"))


def records(path):
    out = {}
    for part in open(path).read().split(">")[1:]:
        head, _, body = part.partition("\n")
        out[head] = body.replace("\n", "")
    return out


SORT = ["--min-aligned-bp", "10", "--min-query-cov", "0.10", "--orient-to-reference"]


def sort(spark, folder, *more, suffix=""):
    ref, assembly, coords = fx.sort_inputs(folder, suffix)
    main(["sort", "--ref-fasta", ref, "-f", assembly, "-c", coords, "-o", str(folder / "out" / "s"), *SORT, *more], spark)
    return folder / "out"


def test_help(capsys):
    main([])
    said = capsys.readouterr().out
    assert all(x in said for x in ("sort", "fix", "scaffold"))
    for command, option in (("sort", "--min-aligned-bp"), ("fix", "--auto"), ("scaffold", "--fixed-gap-bp")):
        with pytest.raises(SystemExit) as end:
            main([command, "--help"])
        assert end.value.code == 0 and option in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["nothing"])


def test_sort(spark, tmp_path):
    out = sort(spark, tmp_path, "--discarded-fasta", str(tmp_path / "lost.fa"))
    rows = {r["contig"]: r for r in table(out / "s.contig_assignments.tsv")}
    assert list(rows) == ["contigA", "contigB", "contigC", "contigDup", "contigNo"]
    assert [rows[c]["status"] for c in rows] == ["kept", "kept", "kept", "duplicate_overlap", "no_alignment"]
    dup = rows["contigDup"]
    assert (dup["kept"], dup["overlap_best_contig"], dup["overlap_best_new_name"], dup["overlap_best_bp"], dup["novel_ref_bp"], dup["novel_ref_frac"]) == ("no", "contigA", "chr1_contigA", "70", "0", "0.0000")
    c = rows["contigC"]
    assert (c["orientation"], c["reverse_complemented"], c["ref_midpoint"], c["ref_cov"], c["avg_identity"], c["order_in_ref"]) == ("-", "yes", "39.5", "0.6000", "97.000", "1")
    assert rows["contigNo"]["ref_start"] == "." and rows["contigNo"]["query_cov"] == "0.0000"
    seqs = records(out / "s.ordered.fa")
    assert [h.split()[0] for h in seqs] == ["chr1_contigA", "chr1_contigB", "chr2_contigC"]
    assert seqs[[h for h in seqs if "contigC" in h][0]] == "T" * 10 + "C" * 50
    assert list(records(tmp_path / "lost.fa")) == ["contigDup status=duplicate_overlap", "contigNo status=no_alignment"]
    summary = table(out / "s.chromosome_summary.tsv")
    assert [(r["ref"], r["kept_contigs"], r["covered_ref_bp"], r["ordered_new_names"]) for r in summary] == [("chr1", "2", "120", "chr1_contigA,chr1_contigB"), ("chr2", "1", "60", "chr2_contigC")]
    assert [r["contig"] for r in table(out / "s.contig_ref_matches.tsv")] == ["contigA", "contigB", "contigC", "contigDup"]
    text = (out / "s.run_summary.txt").read_text()
    assert "kept_contigs\t3\n" in text and "status_duplicate_overlap\t1\n" in text and "coords_rows_skipped_unknown_query\t0\n" in text


def test_outputs_as_parts(spark, tmp_path):
    whole = sort(spark, tmp_path)
    (tmp_path / "b").mkdir()
    parts = sort(spark, tmp_path / "b", "--parts")

    def read(path):
        return [line for p in sorted(path.glob("part-*")) for line in p.read_text().splitlines()]

    for name in ("s.contig_assignments.tsv", "s.contig_ref_matches.tsv", "s.chromosome_summary.tsv"):
        lines = (whole / name).read_text().splitlines()
        assert [x for x in read(parts / name) if x != lines[0]] == lines[1:] and lines[0] in read(parts / name)
    assert read(parts / "s.ordered.fa") == (whole / "s.ordered.fa").read_text().splitlines()


def test_sort_without_overlap_filter_gzip_and_reports_only(spark, tmp_path):
    out = sort(spark, tmp_path, "--no-overlap-filter", "--simple-headers", suffix=".gz")
    rows = {r["contig"]: r for r in table(out / "s.contig_assignments.tsv")}
    assert rows["contigDup"]["status"] == "kept" and rows["contigDup"]["order_in_ref"] == "2" and rows["contigDup"]["overlap_best_bp"] == "."
    assert list(records(out / "s.ordered.fa")) == ["chr1_contigA", "chr1_contigDup", "chr1_contigB", "chr2_contigC"]
    (tmp_path / "b").mkdir()
    assert not (sort(spark, tmp_path / "b", "--reports-only") / "s.ordered.fa").exists()


def test_sort_statuses_and_second_reference(spark, tmp_path):
    ref = fx.write(tmp_path / "r.fa", fx.fasta_text([("r1", "A" * 100), ("r2", "A" * 100)]))
    assembly = fx.write(tmp_path / "a.fa", fx.fasta_text([("few", "A" * 50), ("thin", "A" * 1000), ("torn", "A" * 60), ("good", "A" * 60)]))
    rows = [("r1", "few", 1, 5, 1, 5, 99.0, 100, 50), ("r1", "thin", 1, 20, 1, 20, 99.0, 100, 1000), ("r1", "torn", 1, 20, 1, 20, 99.0, 100, 60), ("r2", "torn", 1, 20, 21, 40, 99.0, 100, 60), ("rX", "torn", 1, 20, 41, 60, 90.0, 77, 60), ("r1", "good", 1, 60, 1, 60, 99.0, 100, 60), ("r2", "good", 1, 10, 1, 10, 99.0, 100, 60), ("r1", "stranger", 1, 9, 1, 9, 99.0, 100, 9)]
    coords = fx.write(tmp_path / "c.coords", fx.coords_text(rows, piped=False) + "1 2 x 4\n\n")
    main(["sort", "--ref-fasta", ref, "-f", assembly, "-c", coords, "-o", str(tmp_path / "s"), "--min-aligned-bp", "10", "--min-query-cov", "0.1", "--min-best-ref-share", "0.5"], spark)
    got = {r["contig"]: r for r in table(tmp_path / "s.contig_assignments.tsv")}
    assert [got[c]["status"] for c in ("few", "thin", "torn", "good")] == ["below_min_aligned_bp", "below_min_query_cov", "ambiguous_ref_match", "kept"]
    assert (got["torn"]["assigned_ref"], got["torn"]["second_ref"], got["torn"]["total_refs_matched"]) == ("r1", "r2", "3")
    assert "skipped_unknown_query\t1\n" in (tmp_path / "s.run_summary.txt").read_text()
    assert [r["ref_length"] for r in table(tmp_path / "s.contig_ref_matches.tsv") if r["ref"] == "rX"] == ["77"]


def fix(spark, folder, rows, lengths, *more):
    assembly = fx.write(folder / "assembly.fa", fx.fasta_text([(f"{n} words", ("ACGT" * 100)[:k]) for n, k in lengths.items()]))
    coords = fx.write(folder / "c.coords", fx.coords_text(rows))
    main(["fix", "-f", assembly, "-c", coords, "-o", str(folder / "f.fa"), "--report", str(folder / "f.tsv"), *more], spark)
    return records(folder / "f.fa"), table(folder / "f.tsv")


CHIMERIC_LENGTHS = {"contig_01": 10, "contig_04": 40, "contig_12": 40, "contig_inv_mid": 55}


def test_fix_named(spark, tmp_path):
    names = fx.write(tmp_path / "names.txt", "# comment\n\ncontig_inv_mid\ncontig_04\n")
    seqs, report = fix(spark, tmp_path, fx.CHIMERIC, CHIMERIC_LENGTHS, "--contigs", "contig_04", "contig_12", "gone", "contig_01", "--contigs-file", names, "--min-segment-bp", "5")
    assert [h.split()[0] for h in seqs] == ["contig_01", "chrom02-contig_04-a", "chrom07-contig_04-b", "chrom04-contig_12-a", "chrom05-contig_12-b", "chrom04-contig_12-c", "chrom06-contig_inv_mid-a", "chrom06-contig_inv_mid-b", "chrom06-contig_inv_mid-c"]
    assert "contig_01 words" in seqs
    whole = ("ACGT" * 100)[:40]
    assert [seqs[h] for h in seqs if "contig_12-" in h] == [whole[:5], whole[5:35], whole[35:]]
    assert [(r["original_contig"], r["status"]) for r in report if r["status"] != "split"] == [("gone", "target_missing"), ("contig_01", "not_split_no_alignment")]
    assert [(r["slice_start"], r["slice_end"], r["orientation"]) for r in report if r["original_contig"] == "contig_inv_mid"] == [("1", "15", "+"), ("16", "35", "-"), ("36", "55", "+")]


def test_fix_pieces_only_orientation_and_short_pieces(spark, tmp_path):
    seqs, report = fix(spark, tmp_path, fx.CHIMERIC, CHIMERIC_LENGTHS, "--contigs", "contig_12", "contig_inv_mid", "--pieces-only", "--orient-to-reference", "--simple-headers", "--min-segment-bp", "5", "--min-piece-bp", "16")
    assert list(seqs) == ["chrom06-contig_inv_mid-b", "chrom06-contig_inv_mid-c"]
    turned = ("ACGT" * 100)[15:35][::-1].translate(str.maketrans("ACGT", "TGCA"))
    assert seqs["chrom06-contig_inv_mid-b"] == turned
    assert [r["status"] for r in report] == ["not_split_short_piece", "split", "split"]


def test_fix_auto(spark, tmp_path):
    options = ("--auto", "--simple-headers", "--min-segment-bp", "10", "--auto-breakpoint-penalty-bp", "50", "--auto-min-piece-aligned-bp", "50")
    seqs, report = fix(spark, tmp_path, fx.NOISY, fx.NOISY_LENGTHS, *options)
    assert list(seqs) == ["small_inv words", "chrom02-chimera-a", "chrom07-chimera-b", "chrom06-inv_mid-a", "chrom06-inv_mid-b", "chrom06-inv_mid-c", "chrom10-indels-a", "chrom11-indels-b", "alone words"]
    assert report[0]["reason"] == "Auto smoothing retained one piece: discordant support (19.7 identity-weighted bp) did not overcome the breakpoint penalty (50.0)."
    assert report[1]["reason"] == "2 auto pieces inferred from 2 alignment blocks after smoothing 0 weak transition(s) with breakpoint penalty 50.0."
    merged = [r for r in report if r["new_contig"] == "chrom10-indels-a"][0]
    assert (merged["avg_identity"], merged["segment_count"], merged["slice_end"]) == ("98.918", "2", "120")


def test_fix_auto_sensitive_and_rejected(spark, tmp_path):
    _, report = fix(spark, tmp_path, fx.NOISY, fx.NOISY_LENGTHS, "--auto", "--auto-sensitive", "--min-segment-bp", "10")
    assert sum(r["original_contig"] == "small_inv" for r in report) == 3
    _, report = fix(spark, tmp_path, fx.NOISY, fx.NOISY_LENGTHS, "--auto", "--min-segment-bp", "10", "--auto-breakpoint-penalty-bp", "50")
    assert {r["status"] for r in report} == {"not_split_auto_smooth"}
    assert "weak dominant support (119 aligned bp; required 50000)" in " ".join(r["reason"] for r in report) or "required 50000" in report[1]["reason"]


def test_fix_needs_targets(spark, tmp_path):
    with pytest.raises(SystemExit) as end:
        fix(spark, tmp_path, fx.CHIMERIC, CHIMERIC_LENGTHS)
    assert end.value.code == 2


def scaffold(spark, folder, *more, rows=None, seqs=(("chr1_contigA", "AAAA"), ("chr1_contigB", "TTT"), ("extra e", "CC"), ("chr2_contigC", "GG"))):
    rows = rows or [("contigA", "yes", "chr1_contigA", "chr1", "1", "1", "4"), ("contigB", "YES", "chr1_contigB", "chr1", "2", "10", "12"), ("contigC", "1", "chr2_contigC", "chr2", "1", "2", "3"), ("x", "no", "chr1_contigA", "chr1", "1", "1", "1")]
    head = "contig kept new_name assigned_ref order_in_ref ref_start ref_end".split()
    table_path = fx.write(folder / "a.tsv", "\n".join("\t".join(r) for r in [head, *rows]) + "\n")
    fasta = fx.write(folder / "o.fa", fx.fasta_text(seqs))
    main(["scaffold", "-f", fasta, "-a", table_path, "-o", str(folder / "c"), *more], spark)
    return records(folder / "c.scaffold.fa")


def test_scaffold(spark, tmp_path):
    seqs = scaffold(spark, tmp_path)
    assert seqs == {"chr1 contigs=2 sequence_bp=7 gap_bp=5 gap_mode=inferred": "AAAANNNNNTTT", "chr2 contigs=1 sequence_bp=2 gap_bp=0 gap_mode=inferred": "GG", "extra e": "CC"}
    gap = table(tmp_path / "c.scaffold_gaps.tsv")
    assert [(g["raw_inferred_gap_bp"], g["gap_bp"], g["gap_mode"]) for g in gap] == [("5", "5", "inferred")]
    rows = table(tmp_path / "c.scaffold_summary.tsv")
    assert [(r["scaffold"], r["scaffold_bp"], r["first_ref_start"], r["last_ref_end"]) for r in rows] == [("chr1", "12", "1", "12"), ("chr2", "2", "2", "3"), ("extra", "2", ".", ".")]
    assert "unassigned_records\t1" in (tmp_path / "c.run_summary.txt").read_text()
    assert scaffold(spark, tmp_path, "--fixed-gap-bp", "2", "--simple-headers")["chr1"] == "AAAANNTTT"


@pytest.mark.parametrize(
    ("rows", "seqs", "more"),
    [
        ([("a", "yes", "n1", "r", "1", "1", "4")], (("other", "A"),), ()),
        ([("a", "yes", "n1", "r", "1", "1", "4"), ("b", "yes", "n1", "r", "2", "5", "6")], (("n1", "A"),), ()),
        ([("a", "yes", "n1", "r", "x", "1", "4")], (("n1", "A"),), ()),
        ([("a", "yes", "n1", "r", "1", "1", "4")], (("n1", "A"), ("n1", "C")), ()),
        ([("a", "yes", "n1", "r", "1", "1", "4")], (("n1", "A"),), ("--fixed-gap-bp", "-1")),
    ],
)
def test_scaffold_errors(spark, tmp_path, rows, seqs, more, capsys):
    with pytest.raises(SystemExit) as end:
        scaffold(spark, tmp_path, *more, rows=rows, seqs=seqs)
    assert end.value.code == 2 and "ERROR" in capsys.readouterr().err
