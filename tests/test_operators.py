import itertools
import random
import time
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lociweave import storing
from lociweave.functions import sequence as fn
from lociweave.operators import assign, blocks, intervals, segment
from lociweave.operators.assign import SortOptions, claim, overlap_components
from lociweave.sources import readers

from . import fixtures as fx


def random_sets(seed, cases=60):
    rng = random.Random(seed)
    return [(k, s, s + rng.randint(-1, 12)) for k in range(cases) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]


def cells(rows):
    out = {}
    for k, s, e in rows:
        out.setdefault(k, set()).update(range(s, e))
    return {k: v for k, v in out.items() if v}


def test_interval_algebra_against_sets(spark):
    a, b = random_sets(1), random_sets(2)
    da, db = (spark.createDataFrame(x, "k int, start long, end long") for x in (a, b))
    ca, cb = cells(a), cells(b)
    merged = [tuple(r) for r in intervals.union(da, ["k"]).collect()]
    assert cells(merged) == ca
    for k in ca:
        spans = sorted(r[1:] for r in merged if r[0] == k)
        assert all(x[1] < y[0] for x, y in itertools.pairwise(spans))
    assert cells(tuple(r) for r in intervals.subtract(da, db, ["k"]).collect()) == {k: v - cb.get(k, set()) for k, v in ca.items() if v - cb.get(k, set())}
    shared = {r["k"]: r["bp"] for r in intervals.intersect_bp(intervals.union(da, ["k"]), intervals.union(db, ["k"]), ["k"], width=7).collect()}
    assert shared == {k: len(ca[k] & cb[k]) for k in ca if ca[k] & cb.get(k, set())}


@pytest.fixture
def many_parts(spark):
    """Range sorts of several parts, though there are few rows."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "5")
    spark.conf.set(names[1], "false")
    yield
    for n, b in zip(names, before, strict=True):
        spark.conf.set(n, b)


def test_spread_union_and_islands(spark, many_parts):
    """One key holds most rows, and single intervals reach over several parts."""
    rng = random.Random(21)
    for dense in (0.3, 3.0):
        rows = [(1, s, s + rng.randint(0, 9)) for s in (rng.randint(0, int(2400 / dense)) for _ in range(400))] + random_sets(22, 8) + [(1, 100, 100 + int(900 / dense)), (9, 5, 6)]
        df = spark.createDataFrame(rows, "k int, start long, end long")
        want = sorted(tuple(r) for r in intervals.union(df, ["k"]).collect())
        assert sorted(tuple(r) for r in intervals.spread_union(df, ["k"]).collect()) == want
        numbered = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "k int, start long, end long, n int")
        got = intervals.islands(numbered, ["k"]).collect()
        assert sorted(map(str, intervals.islands(numbered, ["k"], spread=False).select(*got[0].asDict()).collect())) == sorted(map(str, got))
        assert sorted(r["n"] for r in got) == [n for n, (_, s, e) in enumerate(rows) if e > s]
        for r in got:
            assert r["island"] == next(s for k, s, e in want if k == r["k"] and s <= r["start"] and r["end"] <= e)
        assert intervals._swept(df.filter("end > start and k = 1"), ["k"]).select("_part").distinct().count() > 2
    assert intervals.spread_union(df.limit(0), ["k"]).count() == 0


def loop_blocks(rows, gap):
    out = []
    for s, e, ref, strand, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[4])):
        last = out[-1] if out else None
        if last and (last[2], last[3]) == (ref, strand) and s <= last[1] + gap:
            last[1] = max(last[1], e)
            last[4] += 1
        else:
            out.append([s, e, ref, strand, 1])
    return [tuple(x) for x in out]


def test_merged_blocks_against_a_loop(spark):
    rng = random.Random(5)
    cases = {f"c{k}": [(s := rng.randint(0, 80), s + rng.randint(1, 20), rng.choice("ab"), rng.choice("+-"), n) for n in range(rng.randint(1, 9))] for k in range(80)}
    rows = [(c, n, ref, strand, s, e, s, e, e - s, 99.0 * (e - s), 1) for c, x in cases.items() for s, e, ref, strand, n in x]
    df = spark.createDataFrame(rows, "contig string, ord long, ref string, orientation string, query_start long, query_end long, ref_start long, ref_end long, aligned_bp long, identity_bp double, segment_count long")
    for gap in (0, 3):
        got = {}
        for r in blocks.merge_blocks(df, gap).orderBy("contig", "block_no").collect():
            got.setdefault(r["contig"], []).append((r["query_start"], r["query_end"], r["ref"], r["orientation"], r["segment_count"]))
        assert got == {c: loop_blocks(x, gap) for c, x in cases.items()}


def block(ref, strand, bp, idy=100.0):
    return SimpleNamespace(ref=ref, orientation=strand, aligned_bp=bp, identity_bp=idy * bp)


def test_best_cuts_against_all_segmentations():
    rng = random.Random(9)

    def cost(bs, runs, penalty):
        total = 0.0
        for k, (a, z) in enumerate(runs):
            s = segment.Support()
            for b in bs[a:z]:
                s.add(b)
            total = (total + s.discordant()) + (penalty if k else 0.0)
        return total

    for _ in range(60):
        bs = [block(rng.choice("ab"), rng.choice("+-"), rng.randint(1, 9)) for _ in range(rng.randint(1, 7))]
        penalty = rng.choice((1.0, 3.0, 6.0))
        every = []
        for bits in itertools.product((0, 1), repeat=len(bs) - 1):
            edges = [0, *(i + 1 for i, x in enumerate(bits) if x), len(bs)]
            runs = list(itertools.pairwise(edges))
            every.append((cost(bs, runs, penalty), len(runs)))
        got = segment.best_cuts(bs, penalty)
        assert (cost(bs, got, penalty), len(got)) == min(every)


def quadratic_cuts(bs, penalty):
    """Best cuts by trying every start for every end, in plain decimals; ties go to fewer cuts, then to the earliest start."""
    best = [(0.0, 0, None)]
    for end in range(1, len(bs) + 1):
        found = None
        for start in range(end):
            s = segment.Support()
            for b in bs[start:end]:
                s.add(b)
            c = (best[start][0] + s.discordant() + (penalty if start else 0.0), best[start][1] + (1 if start else 0), start)
            found = c if found is None or c[:2] < found[:2] else found
        best.append(found)
    runs, end = [], len(bs)
    while end:
        runs.append((best[end][2], end))
        end = best[end][2]
    return runs[::-1]


def test_running_cuts_equal_the_quadratic_search():
    rng = random.Random(11)
    for k in range(240):
        idy = (lambda: 100.0) if k % 3 == 0 else (lambda: rng.choice((97.0, 99.0, 99.5))) if k % 3 == 1 else (lambda: round(rng.uniform(80, 100), 2))
        bp = (lambda: rng.randint(1, 9)) if k % 3 == 0 else (lambda: rng.randint(10_000, 90_000))
        bs = [block(rng.choice("abcdefgh"[: 1 + k % 8]), rng.choice("+-"), bp(), idy()) for _ in range(rng.randint(1, 40))]
        penalty = rng.choice((0.0, 1.0, 3.0, 6.0)) if k % 3 == 0 else rng.choice((20_000.0, 50_000.0, 120_000.0))
        assert segment.best_cuts(bs, penalty) == quadratic_cuts(bs, penalty)


def test_cuts_of_a_long_contig_take_linear_time():
    rng = random.Random(12)
    n = 100_000
    signatures, weights = [rng.randrange(4) for _ in range(n)], [rng.randint(1000, 90_000) * 0.99 for _ in range(n)]
    began = time.process_time()
    came = segment.least_cuts(signatures, weights, 50_000.0)
    assert len(came) == n + 1 and time.process_time() - began < 20
    assert sum(z - a for a, z in segment.runs_of(came)) == n


def test_groups_of_streamed_contigs(spark):
    """Contigs over several batches and partitions, against the groups of plain runs."""
    rng = random.Random(13)
    rows, want = [], []
    for c in range(7):
        bs = [SimpleNamespace(contig=f"c{c}", ref=rng.choice("ab"), orientation=rng.choice("+-"), query_start=100 * k, query_end=100 * k + rng.randint(50, 200), aligned_bp=rng.randint(1, 90), identity_bp=97.5 * rng.randint(1, 90), segment_count=rng.randint(1, 3)) for k in range(rng.randint(1, 60))]
        rows += [(b.contig, k, b.ref, b.orientation, b.query_start, b.query_end, b.aligned_bp, b.identity_bp, b.segment_count) for k, b in enumerate(bs)]
        for part, (a, z) in enumerate(quadratic_cuts(bs, 30.0)):
            s = segment.Support()
            for b in bs[a:z]:
                s.add(b)
            top = s.dominant()
            changes = sum((x.ref, x.orientation) != (y.ref, y.orientation) for x, y in itertools.pairwise(bs[a:z]))
            want.append((f"c{c}", part, *top, min(b.query_start for b in bs[a:z]), max(b.query_end for b in bs[a:z]), s.by[top][1], s.by[top][2], sum(b.segment_count for b in bs[a:z]), bs[a].query_start, bs[z - 1].query_end, z - a, s.discordant(), changes))
    df = spark.createDataFrame(rows, "contig string, block_no int, ref string, orientation string, query_start long, query_end long, aligned_bp long, identity_bp double, segment_count long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (before, "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = segment.segment_groups(df.repartition(3), 30.0).collect()
            assert sorted(tuple(r) for r in got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert segment.segment_groups(df.limit(0), 30.0).count() == 0


def test_claim_takes_what_is_new(spark):
    rows = [("r", 1, "a", 100, [(0, 100)]), ("r", 2, "b", 60, [(50, 110)]), ("r", 3, "c", 40, [(100, 140)]), ("s", 1, "d", 5, [(0, 5)])]
    df = spark.createDataFrame(rows, "ref string, rank int, query string, merged_ref_bp long, ref_intervals array<struct<start:long,end:long>>")
    got = {r["query"]: (r["novel_ref_bp"], r["accepted"]) for r in claim(df, SortOptions(min_novel_ref_bp=20, min_novel_ref_frac=0.5)).collect()}
    assert got == {"a": (100, True), "b": (10, False), "c": (40, True), "d": (5, True)}


def plain_claims(rows, o):
    """Verdicts by sets of covered bases, reference by reference."""
    covered, out = {}, {}
    for ref, _, query, total, spans in sorted(rows, key=lambda r: (r[0], r[1])):
        mine = {x for s, e in spans for x in range(s, e)}
        novel = len(mine - covered.setdefault(ref, set()))
        out[query] = (novel, novel > 0 and (novel >= o.min_novel_ref_bp or novel / total >= o.min_novel_ref_frac))
        if out[query][1]:
            covered[ref] |= mine
    return out


@pytest.mark.parametrize("one_task", [0, intervals.ONE_TASK])
def test_claims_by_components(spark, many_parts, monkeypatch, one_task):
    """Contigs of one or several islands, chains over many of them, and a reference that holds nearly all."""
    monkeypatch.setattr(intervals, "ONE_TASK", one_task)
    rng = random.Random(23)
    o = SortOptions(min_novel_ref_bp=15, min_novel_ref_frac=0.5)
    for wide in (300, 6000):
        rows = []
        for k in range(220):
            spans = []
            for _ in range(rng.choice((1, 1, 1, 2, 4))):
                s = rng.randint(0, wide)
                spans.append((s, s + rng.randint(1, 30)))
            merged = []
            for s, e in sorted(spans):
                if merged and s <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                else:
                    merged.append((s, e))
            rows.append(("r" if k % 12 else "s", k, f"q{k}", sum(e - s for s, e in merged), merged))
        df = spark.createDataFrame(rows, "ref string, rank int, query string, merged_ref_bp long, ref_intervals array<struct<start:long,end:long>>")
        assert {r["query"]: (r["novel_ref_bp"], r["accepted"]) for r in claim(df, o).collect()} == plain_claims(rows, o)
        found = {r["query"]: r["component"] for r in overlap_components(df).collect()}
        assert len(found) == len(rows)
        for a, b in itertools.combinations(rows, 2):
            if a[0] == b[0] and any(s < e2 and s2 < e for s, e in a[4] for s2, e2 in b[4]):
                assert found[a[2]] == found[b[2]]
        if wide == 6000:
            assert len(set(found.values())) > 10  # of one reference


def test_sequence_functions(spark):
    row = spark.range(1).select(fn.reverse_complement(F.lit("ACGTnRyX-")).alias("rc"), fn.slice_of(F.lit("abcdef"), F.lit(1), F.lit(4)).alias("cut"), fn.wrapped(F.lit("x" * 161)).alias("w"), fn.wrapped(F.lit("")).alias("none"), fn.boundary(F.lit(3), F.lit(4)).alias("b")).first()
    assert row["rc"] == "-XrYnACGT" and row["cut"] == "bcd" and row["w"] == "x" * 80 + "\n" + "x" * 80 + "\nx\n" and row["none"] == "" and row["b"] == 3

    def label(i):
        out = ""
        while i >= 0:
            out, i = chr(97 + i % 26) + out, i // 26 - 1
        return out

    which = [0, 25, 26, 701, 702, 18277, 18278, 10**12]
    got = spark.createDataFrame([(i,) for i in which], "i long").select("i", fn.alpha_label(F.col("i")).alias("l")).collect()
    assert {r["i"]: r["l"] for r in got} == {i: label(i) for i in which}


def test_readers(spark, tmp_path):
    text = "junk\n>a first > second\r\nAC GT\r\n  TT \n\n>b\n>c x\nGG\n"
    for name in ("x.fa", "x.fa.gz"):
        rows = readers.read_fasta(spark, fx.write(tmp_path / name, text)).orderBy("ord").collect()
        assert [(r["name"], r["header"], r["seq"]) for r in rows] == [("a", ">a first > second", "AC GTTT"), ("b", ">b", ""), ("c", ">c x", "GG")]
    fai = fx.write(tmp_path / "y.fa.fai", "a\t5\t3\t60\t61\n\nb\t7\t9\t60\t61\n")
    assert [(r["name"], r["length"]) for r in readers.fasta_lengths(spark, str(tmp_path / "y.fa")).orderBy("ord").collect()] == [("a", 5), ("b", 7)]
    assert readers.index_path(spark, "z", fai) == fai and readers.index_path(spark, str(tmp_path / "x.fa")) is None
    for k, bad in enumerate(("a\t5\n", "a\t5\tx\t60\t61\n", "a\t5\t3\t\t61\n", "a\tfive\t3\t60\t61\n")):
        with pytest.raises(Exception, match="Malformed FASTA index"):
            readers.parse_fai(readers.numbered_lines(spark, fx.write(tmp_path / f"bad{k}.fai", bad))).collect()
    rows = [("r", "q", 1, 1, 9, 3, 99.5, 10, 20), ("r", "q2", 5, 1, 9, 3, 50.0, 10, 20)]
    for piped in (True, False):
        coords = fx.write(tmp_path / f"{piped}.coords", fx.coords_text(rows, piped) + "1 2 3\n1 2 x 4 5 6 7.0 8 9 r q\n")
        got = readers.read_coords(spark, coords, 60.0).collect()
        assert [(r["query"], r["orientation"], r["len_query"], r["identity"]) for r in got] == [("q", "+", 7, 99.5)]
        assert readers.read_coords(spark, coords).count() == 2
    names = readers.requested_names(spark, ["b", " a ", "#x", "", "b"], fx.write(tmp_path / "n.txt", "c\n# no\n\na\n")).orderBy("ord").collect()
    assert [r["name"] for r in names] == ["b", "a", "c"]


def test_fetch_fails_without_record(spark):
    fasta = spark.createDataFrame([(0, "a", ">a", "AC")], "ord long, name string, header string, seq string")
    assert readers.fetch(spark.createDataFrame([("a",)], "query string"), fasta).first()["seq"] == "AC"
    with pytest.raises(Exception, match="no FASTA record"):
        readers.fetch(spark.createDataFrame([("z",)], "query string"), fasta).collect()


def test_streamed_metrics(spark, tmp_path):
    from lociweave.streaming.coords import stream_metrics, stream_segments

    (tmp_path / "in").mkdir()
    fx.write(tmp_path / "in" / "a.coords", fx.coords_text([("r", "q", 1, 10, 1, 10, 99.0, 100, 20), ("r", "q", 5, 14, 5, 14, 97.0, 100, 20)]))
    lengths = [spark.createDataFrame([(n, k)], "name string, length long") for n, k in (("q", 20), ("r", 100))]
    seen = []
    stream = stream_metrics(stream_segments(spark, str(tmp_path / "in")), *lengths, lambda df, n: seen.extend(df.collect()), str(tmp_path / "check"))
    stream.awaitTermination()
    assert [(r["query"], r["segment_count"], r["merged_query_bp"], r["avg_identity"]) for r in seen] == [("q", 2, 14, 98.0)]


def test_shared_folder_is_the_clusters_own_or_local():
    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"))

    assert storing.shared_folder(session("hdfs://host/x/", "spark://host:7077")) == "hdfs://host/x"
    with pytest.raises(ValueError):
        storing.shared_folder(session(None, "spark://host:7077"))
    one, again, other = (storing.shared_folder(session(None, f"local[{k}]")) for k in (2, 2, 4))
    assert one == again != other


def test_best_overlap_against_sets(spark, monkeypatch):
    """Every candidate against all stronger ones, some of them accepted; no row of a pair is made, however small the blocks are."""
    rng = random.Random(31)
    rows, sets = [], {}
    for ref in ("a", "b"):
        for rank in range(1, 61):
            points = sorted(rng.sample(range(400), 2 * rng.randint(1, 6)))
            spans = list(zip(points[::2], points[1::2], strict=True)) if rank % 9 else []
            sets[f"{ref}{rank}"] = {x for s, e in spans for x in range(s, e)}
            rows.append((f"{ref}{rank}", ref, rank, len(sets[f"{ref}{rank}"]), spans))
    rows.append(("c1", "c", 1, 5, [(0, 5)]))
    df = spark.createDataFrame(rows, "query string, ref string, rank int, merged_ref_bp long, ref_intervals array<struct<start:long,end:long>>").repartition(4)
    accepted = {r[0] for r in rows if rng.random() < 0.6}
    want = {}
    for query, ref, rank, *_ in rows:
        found = [(len(sets[o[0]] & sets[query]), -o[2], o[0]) for o in rows if o[1] == ref and o[2] < rank and o[0] in accepted]
        if found and max(found)[0]:
            want[query] = (max(found)[2], max(found)[0])
    for n, held in ((8, 4_000_000), (3, 50), (1, 4_000_000)):
        monkeypatch.setattr(assign, "BLOCKS", n)
        monkeypatch.setattr(assign, "HELD", held)
        best = assign.best_overlap(df, spark.createDataFrame([(a,) for a in sorted(accepted)], "query string"))
        assert "explode(ref_intervals" not in best._jdf.queryExecution().toString()
        assert {r["query"]: (r["overlap_best_contig"], r["overlap_best_bp"]) for r in best.collect()} == want
    order = sorted((ref, 0, passing, rank, query, [s for s, _ in spans], [e for _, e in spans]) for query, ref, rank, _, spans in rows for passing in (False, True) if query in accepted or not passing)
    batch = pa.RecordBatch.from_pylist([dict(zip(("ref", "block", "passing", "rank", "query", "starts", "ends"), r, strict=True)) for r in order])
    for at_once, cells in ((256, 4_000_000), (7, 1), (3, 2000)):
        monkeypatch.setattr(assign, "AT_ONCE", at_once)
        monkeypatch.setattr(assign, "CELLS", cells)
        out = [r for b in assign._compared(batch.slice(k, 17) for k in range(0, batch.num_rows, 17)) for r in b.to_pylist()]
        assert {r["query"]: (r["overlap_best_contig"], r["overlap_best_bp"]) for r in out} == want


def test_longest_keeps_the_union(spark, tmp_path):
    """Both halves of segments are reduced to a row a place before one task sorts those of a reference."""
    from lociweave.plans import analog

    rng = random.Random(41)
    rows = [("r", s, s + rng.randint(-1, 4)) for s in (rng.randint(0, 90) for _ in range(3000))] + [(None, 5, 9), (None, 5, 7)]
    df = spark.createDataFrame(rows, "k string, start long, end long").repartition(4)
    longest = intervals.longest(df, ["k"])
    assert longest.count() == len({r[:2] for r in rows if r[2] > r[1]})
    assert intervals.union(longest, ["k"]).exceptAll(intervals.union(df, ["k"])).count() == 0 == intervals.union(df, ["k"]).exceptAll(intervals.union(longest, ["k"])).count()
    for half in analog._halves(spark, "/root/testdata/sf0.001"):
        plan = half._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan[plan.rindex("Window") :]
