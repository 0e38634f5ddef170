"""FASTA in chunks and by byte ranges, lines of records, outputs as parts and by URI."""

import random

import pytest
from pyspark.sql import functions as F

from lociweave import files, sinks
from lociweave.cli import main
from lociweave.functions.sequence import reverse_complement
from lociweave.sources import chunked, readers

from . import fixtures as fx
from .test_commands import SORT, records, sort, table


def random_fasta(seed, n=40, longest=2000, width=60):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        size = rng.choice((0, 1, width - 1, width, width + 1, rng.randint(2, longest)))
        out.append((f"n{k} words {k}", "".join(rng.choices("ACGTN", k=size))))
    text = "junk before\n" + "".join(f">{h}\n" + "".join(s[a : a + width] + "\n" for a in range(0, len(s), width)) for h, s in out)
    return out, text


@pytest.fixture
def small_splits(spark):
    """Splits far smaller than records."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "700b")
    spark.conf.set(names[1], "1b")
    yield
    for n, b in zip(names, before, strict=True):
        spark.conf.set(n, b)


def test_records_over_splits(spark, tmp_path, small_splits):
    want, text = random_fasta(1)
    path = fx.write(tmp_path / "x.fa", text)
    assert spark.read.text(path).rdd.getNumPartitions() > 10
    for chunk in (50, 1 << 20):
        fasta = chunked.read_chunks(spark, path, chunk)
        rows = fasta.records.orderBy("ord").collect()
        assert [(r["name"], r["header"], r["length"]) for r in rows] == [(h.split()[0], f">{h}", len(s)) for h, s in want]
        pieces = {}
        for r in fasta.pieces.orderBy("ord", "start").collect():
            assert r["start"] == len(pieces.get(r["ord"], ""))
            pieces[r["ord"]] = pieces.get(r["ord"], "") + r["seq"]
        assert [pieces.get(r["ord"], "") for r in rows] == [s for _, s in want]
    whole = readers.read_fasta(spark, path).orderBy("ord").collect()
    assert [(r["header"], r["seq"]) for r in whole] == [(f">{h}", s) for h, s in want]
    assert [r["length"] for r in readers.fasta_lengths(spark, path).orderBy("ord").collect()] == [len(s) for _, s in want]


def test_a_folder_is_read_in_order(spark, tmp_path):
    """Parts of unlike sizes, which Spark's readers take up in another order, and a record over several parts."""
    (tmp_path / "d").mkdir()
    bodies = [">a\nAC\n", ">b\n" + "G" * 500 + "\n", "T" * 90 + "\n", "C\n>c\nA\n", ">d x\n" + "T" * 3000 + "\n", "\n"]
    for k, b in enumerate(bodies):
        fx.write(tmp_path / "d" / f"part-{k:05d}.txt", b)
    rows = readers.read_fasta(spark, str(tmp_path / "d")).orderBy("ord").collect()
    assert [(r["name"], r["seq"]) for r in rows] == [("a", "AC"), ("b", "G" * 500 + "T" * 90 + "C"), ("c", "A"), ("d", "T" * 3000)]
    lines = [r["value"] for r in readers.numbered_lines(spark, str(tmp_path / "d")).orderBy("ord").collect()]
    assert lines == "".join(bodies).split("\n")[:-1]


def index_of(text):
    """A FASTA index by reading the text line by line."""
    out, at, name, size, offset, bases, width = [], 0, None, 0, 0, 0, 0
    for line in text.splitlines(keepends=True):
        at += len(line)
        if line.startswith(">"):
            if name:
                out.append((name, size, offset, bases, width))
            name, size, offset, bases, width = line[1:].split()[0], 0, at, 0, 0
        elif name:
            size += len(line.strip())
            bases, width = max(bases, len(line.strip())), max(width, len(line))
    return [*out, (name, size, offset, bases, width)]


def test_byte_ranges(spark, tmp_path):
    want, text = random_fasta(2)
    path = fx.write(tmp_path / "x.fa", text)
    fai = "".join("\t".join(map(str, r)) + "\n" for r in index_of(text))
    fx.write(tmp_path / "x.fa.fai", fai)
    names = spark.createDataFrame([(f"n{k}",) for k in range(0, 40, 3)], "name string")
    place = chunked.seekable(spark, path)
    index = readers.parse_fai(readers.numbered_lines(spark, path + ".fai"))
    for chunk in (7, 1 << 20):
        got = {}
        for r in chunked.indexed_pieces(names, index, place, chunk).orderBy("name", "start").collect():
            assert r["start"] == len(got.get(r["name"], ""))
            got[r["name"]] = got.get(r["name"], "") + r["seq"]
        assert got == {f"n{k}": want[k][1] for k in range(0, 40, 3) if want[k][1]}
    assert readers.sequences(spark, names, path).groupBy("name").agg(F.sum(F.length("seq")).alias("n")).count() == len(got)
    long = max(index_of(text), key=lambda r: r[1])
    wrong = [(0, -1, 0), (0, 1, 0), (0, 0, 1), (0, 0, -2)]
    for _, size, offset in wrong:
        bad = spark.createDataFrame([(0, long[0], long[1] + size, long[2] + offset, *long[3:])], "ord long, name string, length long, offset long, line_bases long, line_width long")
        with pytest.raises(Exception, match="doesn't fit the FASTA"):
            chunked.indexed_pieces(bad.select("name"), bad, place).collect()
    with pytest.raises(Exception, match="no index entry"):
        chunked.indexed_pieces(spark.createDataFrame([("z",)], "name string"), index, place).collect()
    with pytest.raises(Exception, match="no FASTA record"):
        chunked.named_pieces(chunked.read_chunks(spark, path), spark.createDataFrame([("z",)], "name string")).collect()
    assert chunked.seekable(spark, path + ".gz") is None and chunked.seekable(spark, "file://" + path) == path


def test_lines_of_pieces(spark):
    """Pieces of any cut, in any order, become the lines of the whole sequence."""
    rng = random.Random(4)
    heads, pieces, want = [], [], []
    for k in range(30):
        s = "".join(rng.choices("ACGT", k=rng.choice((0, 1, 79, 80, 81, 160, rng.randint(1, 900)))))
        heads.append((k, f">h{k}"))
        cuts = sorted({0, len(s), *(rng.randint(0, len(s)) for _ in range(rng.randint(0, 9)))})
        pieces += [(k, a, s[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        want += [f">h{k}", *(s[a : a + 80] for a in range(0, len(s), 80))]
    rng.shuffle(pieces)
    got = sinks.fasta_lines(spark.createDataFrame(heads, "k int, header string"), spark.createDataFrame(pieces, "k int, start long, seq string"), ["k"])
    assert [x for r in got.orderBy("k", "line").collect() for x in r["text"].split("\n")] == want


def test_sorted_parts_are_scaffolded_like_one_file(spark, tmp_path):
    rng = random.Random(6)
    lengths = {f"q{k:02d}": rng.randint(60, 400) for k in range(12)}
    assembly = fx.write(tmp_path / "a.fa", fx.fasta_text([(n, "".join(rng.choices("ACGT", k=size))) for n, size in lengths.items()]))
    ref = fx.write(tmp_path / "r.fa", fx.fasta_text([("r1", "A" * 9000), ("r2", "C" * 9000)]))
    rows, at = [], {"r1": 1, "r2": 1}
    for k, (n, size) in enumerate(lengths.items()):
        r = f"r{1 + k % 2}"
        rows.append((r, n, at[r], at[r] + size - 1, *((1, size) if k % 3 else (size, 1)), 99.0, 9000, size))
        at[r] += size + 37
    coords = fx.write(tmp_path / "c.coords", fx.coords_text(rows))
    options = ["--ref-fasta", ref, "-f", assembly, "-c", coords, *SORT]
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        main(["sort", *options, "-o", str(tmp_path / "one" / "s")], spark)
        main(["sort", *options, "-o", f"file:{tmp_path}/parts/s", "--parts"], spark)
        parts = [p for p in (tmp_path / "parts" / "s.ordered.fa").glob("part-*") if p.stat().st_size]
        assert len(parts) > 1
        for place, uri in (("one", str(tmp_path / "one")), ("parts", f"file://{tmp_path}/parts")):
            main(["scaffold", "-f", f"{uri}/s.ordered.fa", "-a", f"{uri}/s.contig_assignments.tsv", "-o", f"file://{tmp_path}/{place}/c"], spark)
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    for name in ("c.scaffold.fa", "c.scaffold_gaps.tsv", "c.scaffold_summary.tsv"):
        assert (tmp_path / "parts" / name).read_text() == (tmp_path / "one" / name).read_text()
    assert len(table(tmp_path / "one" / "c.scaffold_gaps.tsv")) == 10
    assert sum(len(s.replace("N", "")) for s in records(tmp_path / "one" / "c.scaffold.fa").values()) == sum(lengths.values())
    assert "kept_contigs\t12\n" in (tmp_path / "parts" / "s.run_summary.txt").read_text()


def test_index_that_does_not_fit(spark, tmp_path):
    sort(spark, tmp_path)
    assembly = tmp_path / "assembly.fa"
    if not assembly.exists():
        assembly = next(p for p in tmp_path.glob("*.fa") if "contigA" in p.read_text())
    text = assembly.read_text()
    fai = fx.write(tmp_path / "bad.fai", "".join("\t".join(map(str, (n, size + (n == "contigA"), *rest))) + "\n" for n, size, *rest in index_of(text)))
    with pytest.raises(Exception, match="doesn't fit the FASTA"):
        sort(spark, tmp_path, "--assembly-fai", fai)


def test_paths_keep_their_scheme(spark, tmp_path):
    uri = f"file://{tmp_path}/new folder/x.txt"
    files.make_parents(spark, [uri])
    files.write_text(spark, uri, "é\n")
    assert (tmp_path / "new folder" / "x.txt").read_text() == "é\n" and files.exists(spark, uri)
    # a scheme of another name is taken to the file system that is configured for it, with its host
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.bucket.link./data", f"file://{tmp_path}")
    files.write_text(spark, "viewfs://bucket/data/deep/y.txt", "y")
    assert (tmp_path / "deep" / "y.txt").read_text() == "y" and files.qualified(spark, "viewfs://bucket/data/deep/y.txt") == "viewfs://bucket/data/deep/y.txt"
    sinks.write_records(spark.createDataFrame([(2, "b"), (1, "a"), (3, "")], "k int, text string"), uri, ["k"])
    assert (tmp_path / "new folder" / "x.txt").read_text() == "a\nb\n\n"
    assert sorted(p.name for p in (tmp_path / "new folder").iterdir()) == ["x.txt"]


def test_reverse_of_pieces_is_the_reverse_of_the_whole(spark):
    s = "ACGTTGCANN" * 30
    whole = spark.createDataFrame([(s,)], "seq string").select(reverse_complement(F.col("seq")).alias("r")).first()["r"]
    pieces = [(0, a, s[a : a + 33]) for a in range(0, len(s), 33)]
    df = spark.createDataFrame(pieces, "k int, start long, seq string")
    df = df.select("k", (F.lit(len(s)) - F.col("start") - F.length("seq")).alias("start"), reverse_complement(F.col("seq")).alias("seq"))
    got = sinks.fasta_lines(spark.createDataFrame([(0, ">h")], "k int, header string"), df, ["k"]).orderBy("line").collect()
    assert "".join(r["text"].replace("\n", "") for r in got[1:]) == whole


def test_stored_tables_are_removed(spark, tmp_path):
    from lociweave import storing

    before = storing.stored(spark.range(3), "kept")
    with storing.removed_after(spark):
        inner = storing.stored(spark.range(4), "gone")
        assert inner.count() == 4
        place = inner.inputFiles()[0]
        assert files.exists(spark, place)
    assert not files.exists(spark, place) and before.count() == 3 and not storing._OPEN
