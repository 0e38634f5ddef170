"""Each operator against a plain version, over nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lociweave.llm import chat, components, jaccard, media, mixing, nbsvm, oracle, packing, rules, secrets, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2500)]
    base, passage = rng.choices(vocabulary, k=120), rng.choices(vocabulary, k=40)
    texts = []
    for _ in range(45):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 5))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    for _ in range(40):
        w = rng.choices(vocabulary, k=rng.randint(20, 150))
        texts.append(" ".join(w[:10] + passage + w[10:]))
    texts += [None, "", " \n", "one", "One", "one two three", "One two three", "der " * 300, "x\n" * 90, " ".join(base), " ".join(base).upper(), " ".join(rng.choices(vocabulary, k=6000))]
    rng.shuffle(texts)
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or "")) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def odd(spark):
    """Null keys, repeated rows, a key with two texts, columns whose names clash with results."""
    long = " ".join(f"t{i}" for i in range(40))
    data = [(None, long, None), (None, None, "s"), (1, long, "s"), (1, long, "s"), (2, long + " end", "s"), (3, "a b", None), (3, "c d", None), (4, "", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    return df.withColumn("size", F.lit("x")).withColumn("kept", F.lit(9)).withColumn("score", F.lit("y")).withColumn("row", F.lit(0)).withColumn("key", F.lit(0)).withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))


def test_media(spark, docs, rows, empty):
    stored = media.encode_media(docs)
    got = {r["doc_id"]: r for r in media.media_features(stored, arrays=True).collect()}
    features = defaultdict(set)
    for key, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[key]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] == len(payload) + 44 and len(r["pair_times"]) == len(r["pair_codes"])
        features[text or ""].add(r["feature"])
    assert all(len(v) == 1 for v in features.values())
    assert media.media_features(media.encode_media(empty)).count() == 0
    assert media.media_features(media.encode_media(odd(spark))).count() == 8


def test_chat(spark):
    events = [(1, 1, "a", "message", "user", "hi"), (1, 2, "b", "message", "assistant", "old"), (1, 3, "b", "regenerate", "assistant", "n"), (1, 4, "b", "delta", None, "ew"), (1, 5, "a", "edit", "user", "hello"), (1, 6, "b", "delta", None, "<|x"), (2, 1, "z", "message", None, None)]
    messages = chat.final_messages(spark.createDataFrame(events, "conv long, seq long, message string, kind string, role string, text string"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(messages)).collect()}
    turns = "user\nhello\nassistant\nnew<|x\n"
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got[1]["n_turns"] == 2
    assert got[1]["loss_sha256"] == hashlib.sha256(b"new<|x").hexdigest() and got[1]["loss_chars"] == 6
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[2]["loss_chars"] == 0
    rows = spark.createDataFrame([(5, 0, "user", "a"), (5, 0, "user", "a"), (5, None, "assistant", "b"), (None, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.final_messages(chat.turn_events(rows)))).collect()}
    assert got[5]["n_turns"] == 3 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.render(chat.final_messages(chat.turn_events(rows.limit(0))))).count() == 0


def plain_components(sets, percent):
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: root(k) for k in keys}


def shingles(text, words):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, rows, words, percent):
    sets = {k: shingles(t, words) for k, t, *_ in rows}
    want = {k: (len(sets[k]), c) for k, c in plain_components(sets, percent).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_documents(docs, words=words, percent=percent).collect()}
    assert got == want


def test_jaccard_odd_rows(spark, empty):
    assert jaccard.similar_documents(empty).count() == 0
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar_documents(odd(spark)).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4)], key=str)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(99, 98), (98, 99), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98}
    assert components.components(links.limit(0)).count() == 0


def test_rules_count_every_trusted_document(spark):
    rows = [(k, ("common words here " if k % 700 else "sjælden tekst ") + str(k)) for k in range(21_000)]
    docs = spark.createDataFrame([*rows, rows[0], (None, "no key"), (21_000, "not labelled"), (21_001, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(k, 1) for k in range(21_000)], (5, 1), (None, 1), (21_001, 0)], "doc_id long, quality int")
    want = sorted(k for k, _ in [*rows, rows[0]])
    for most, n in ((100_000, 1), (9_000, 3)):
        parts = rules.trusted_documents(docs, labels, most)
        found = [[r["doc_id"] for r in part.select("doc_id").collect()] for part in parts]
        assert sorted(k for f in found for k in f) == want and len(found) == n and max(len(set(f)) for f in found) <= most
    by_hand = rules.apply_rules(docs, docs.filter("doc_id < 21000"))
    for target in (rules.trusted_documents(docs, labels), parts):
        assert rules.apply_rules(docs, target).select("doc_id", "llr").exceptAll(by_hand.select("doc_id", "llr")).count() == 0


def test_rules(spark, docs, rows, empty):
    target = docs.filter("doc_id % 2 = 0").select("text")
    got = {r["doc_id"]: r for r in rules.apply_rules(docs, target).collect()}
    assert len(got) == len(rows)
    buckets = [Counter(), Counter()]

    def grams(t):
        b = (t or "").encode()
        return [((int.from_bytes(b[k : k + 4], "big") * 0x9E3779B1) % 2**32) >> 16 for k in range(len(b) - 3)]

    for k, t, *_ in rows:
        buckets[0].update(grams(t))
        if k % 2 == 0:
            buckets[1].update(grams(t))
    import numpy as np

    raw, trusted = (np.array([c[b] for b in range(rules.BUCKETS)], float) for c in buckets)
    weights = rules.bucket_weights(raw, trusted)
    for k, t, *_ in rows:
        g = grams(t)
        assert got[k]["llr"] == pytest.approx(sum(int(weights[x]) for x in g) / rules.SCALE / max(1, len(g)), abs=1e-12)
        assert got[k]["kept"] == (not got[k]["base_failed"] and got[k]["llr"] >= rules.THRESHOLD)
    assert rules.apply_rules(empty, empty).count() == 0
    again = rules.apply_rules(odd(spark), odd(spark).limit(0))
    assert again.count() == 8 and dict(again.dtypes)["kept"] == "boolean" and not again.filter("llr != 0").count()


def test_mixing(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = {k: len(WORD.findall(t or "")) for k, t, *_ in rows}
    by = defaultdict(int)
    for k, _, _, s, _ in rows:
        by[s] += size[k]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(by.values())
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * by[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * by[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for k, _, _, s, _ in rows:
        r = got[k]
        assert (r["size"], r["source_size"]) == (size[k], by[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * size[k] and r["taken"] == r["copies"] * size[k]
        taken[s] += r["taken"]
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in order)
    assert got == {r["doc_id"]: r for r in mixing.mix(docs.repartition(5)).collect()}
    assert mixing.take(docs).groupBy("doc_id").count().agg(F.sum("count")).first()[0] == sum(r["copies"] for r in got.values())
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0
    m = mixing.mix(odd(spark))
    assert m.count() == 8 and dict(m.dtypes)["size"] == "bigint" and mixing.take(odd(spark)).columns == odd(spark).columns


def test_mixing_of_many_ties_equals_its_sql(spark, monkeypatch):
    import duckdb

    rows = [(k, ("w " * (5 if k % 4 else k % 7)).strip(), f"s{k % 3}" if k % 5 else None) for k in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    c = duckdb.connect()
    c.register("documents", df.toPandas())
    want = sorted(c.execute(oracle.MIXING).fetchall())
    columns = ("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, mixing.mix(df).select(*columns).collect())) == want
    monkeypatch.setattr(mixing, "ONE_TASK", 0)
    monkeypatch.setattr(mixing, "COPIES_AT_ONCE", 2)
    monkeypatch.setattr(mixing, "BROADCAST_KEYS", 0)
    assert sorted(map(tuple, mixing.mix(df).select(*columns).collect())) == want
    same = [(1, "a b c", "x")] * 40 + [(1, "a b c", "y")] * 40 + [(2, None, None)] * 3
    df = spark.createDataFrame(same, "doc_id long, text string, source string")
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r["doc_id"], r["source"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in mixing.take(df).collect()) == +copies and copies[1, "y"] > 0


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for k, t, *_ in rows}
    got = packing.pack_documents(docs).collect()
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        per_doc[r["doc_id"]].append(r)
        per_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    assert set(per_doc) == set(ids)
    for k, pieces in per_doc.items():
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["length"] for r in pieces[1:]] == [1024] * (len(pieces) - 1) and sum(r["length"] for r in pieces) == len(ids[k])
    for places in per_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(per_sequence) <= sum(map(len, ids.values())) / 1024 * 1.05 + 2
    with_ids = {(r["doc_id"], r["piece"]): r["ids"] for r in packing.token_pieces(docs, with_ids=True).collect()}
    assert all([i for p in range(len(per_doc[k])) for i in with_ids[k, p]] == ids[k] for k in ids)
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(odd(spark)).count() == 8


def test_secrets(spark, empty):
    secret = hashlib.sha1(b"x").hexdigest()
    texts = [f'é token = "{secret}" and more', "card 4417744280351547 here", None, "", f"commit {secret} was fine", f'a token = "{secret}" twice token = "{secret}"']
    df = spark.createDataFrame([(k, t, "keep") for k, t in enumerate(texts)] + [(None, texts[0], "keep")], "doc_id long, text string, row string")
    found = secrets.scan(df)
    bad = sorted((str(r["doc_id"]), r["start"], r["n_chars"]) for r in found.filter("is_secret = 1").collect())
    assert bad == sorted((k, m.start(), 40) for k, t in (("0", texts[0]), ("5", texts[5]), ("None", texts[0])) for m in re.finditer(secret, t))
    clean = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert clean[0]["text"] == 'é token = "[SECRET]" and more' and clean[1]["text"] == texts[1] and clean[4]["text"] == texts[4] and clean[2]["text"] is None
    assert clean[5]["text"].count("[SECRET]") == 2 and clean[None]["text"] == clean[0]["text"] and clean[0]["row"] == "keep"
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0
    own = spark.createDataFrame([("a x1y2z3x1y2z3x1y2z3", 2, 20, 1), ("b 1234567812345678", 2, 18, 0)] * 10, "text string, start int, end int, label int")
    assert secrets.train(spark, own).numFeatures == len(secrets.FEATURES)


def test_secrets_in_all_forms(spark):
    rng = random.Random(3)
    value = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=36))
    upper = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
    bare = [f"we saw ghp_{value} in the log", f"it is AKIA{upper}."]
    texts = [f"api_key={value}", f"export TOKEN={value}", f"x\nSECRET={value}\ny", f"go https://a.com/b?access_token={value}&c=1", *bare, 'é password = "hunter2!x" ok', "set pwd=S3cr3t!x9 now"]
    plain = [f"commit={hashlib.sha1(b'y').hexdigest()}", "password: required here", "key: chapter12 of it", "id=01234567-89ab-4cde-8f01-23456789abcd", "key: required, not /usr/local/share/file12.png"]
    df = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts + plain)], "doc_id long, text string, n_chars int")
    clean = [r["text"] for r in secrets.redact(df).orderBy("doc_id").collect()]
    assert clean == ["api_key=[SECRET]", "export TOKEN=[SECRET]", "x\nSECRET=[SECRET]\ny", "go https://a.com/b?access_token=[SECRET]&c=1", "we saw [SECRET] in the log", "it is [SECRET].", 'é password = "[SECRET]" ok', "set pwd=[SECRET] now", *plain]


def test_redaction_passes_on_clashing_columns(spark):
    secret = hashlib.sha1(b"x").hexdigest()
    df = spark.createDataFrame([(1, f'token = "{secret}" a'), (1, f'token = "{secret}" a'), (None, "plain"), (2, None)], "doc_id long, text string")
    names = ("row", "_spans", "key", "start", "n_chars", "features", "score", "doc", "a.b")
    for name in names:
        df = df.withColumn(name, F.lit(7))
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == 4
    assert [r["text"] for r in out.filter("doc_id = 1").collect()] == ['token = "[SECRET]" a'] * 2
    assert {r[name] for r in out.collect() for name in names if name != "n_chars"} == {7}
    long = "x " * 300_000 + f'token = "{secret}"'
    assert secrets.redact(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()["text"].endswith('token = "[SECRET]"')


def test_keys_of_any_type(spark, rows):
    plain = spark.createDataFrame([(f"k{k:03d}", t, float(k)) for k, t, *_ in rows], "name string, text string, number double")
    got = {r["name"]: r["component_id"] for r in jaccard.similar_documents(plain, key="name").collect()}
    want = plain_components({k: shingles(t, 4) for k, t, *_ in rows}, 85)
    assert got == {f"k{k:03d}": f"k{c:03d}" for k, c in want.items()}
    labels = spark.createDataFrame([(f"k{k:03d}", k % 2) for k in range(40)], "name string, quality int")
    assert nbsvm.classify(plain, labels, key="name").count() == len(rows)
    turns = spark.createDataFrame([("a", 1, "user", "x"), ("a", 2, "assistant", "y")], "conv_id string, turn int, role string, text string")
    assert chat.read_back(chat.render(chat.final_messages(chat.turn_events(turns)))).first()["conv_id"] == "a"
    with pytest.raises(TypeError):
        substrings.remove_repeats(plain, key="name")


def test_classes_that_share_64_bits_are_split(spark, docs, rows, monkeypatch):
    real = jaccard.digests
    monkeypatch.setattr(jaccard, "digests", lambda sets: real(sets) & [7, -1])
    profile = jaccard.stored(jaccard.profiles(docs, "doc_id", "text", 4, 85), "profiles")
    clash = profile.groupBy("node").agg(F.min("more").alias("a"), F.max("more").alias("b")).filter("a != b").select("node")
    assert clash.count() == 8
    split = jaccard.split_classes(profile, clash).groupBy("node").agg(F.countDistinct("more").alias("n"))
    assert split.agg(F.max("n")).first()[0] == 1 and split.count() == len({frozenset(shingles(t, 4)) for _, t, *_ in rows})


def test_events_of_turns_fold_back(spark):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}é{t}" * (t % 5)) for c in range(30) for t in range(9)]
    turns += [(40, 0, "user", "ab " * 200_000), (41, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("z"))
    events = chat.turn_events(df)
    assert {"message", "delta", "edit", "regenerate"} == {r["kind"] for r in events.select("kind").distinct().collect()}
    final = chat.final_messages(events.repartition(7))
    got = sorted((r["conv"], r["position"]["turn"] or 0, r["role"], r["text"]) for r in final.collect())
    assert got == sorted((c, t or 0, r or "", x or "") for c, t, r, x in turns)


def test_overlapping_secrets_are_masked_once(spark, monkeypatch):
    text = "secret: !a1b2c3d4e5f6g7h8i9! end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    everything = secrets.scan(df).withColumn("is_secret", F.lit(1))
    assert everything.count() == 2
    monkeypatch.setattr(secrets, "scan", lambda *a, **k: everything)
    assert secrets.redact(df).first()["text"] == "secret: [SECRET] end"


def test_forest_learns_from_all_findings(spark):
    early = spark.range(75_000).selectExpr("concat('a 1234567812345678 ', id) text", "2 start", "18 end", "0 label")
    late = spark.range(800).selectExpr("concat('z x1y2z3x1y2z3x1y2z3 ', id) text", "2 start", "20 end", "1 label")
    model = secrets.train(spark, early.unionByName(late))
    assert model.numClasses == 2
    from pyspark.ml.linalg import Vectors

    assert model.predict(Vectors.dense(secrets.describe("x1y2z3x1y2z3x1y2z3", "z ", " 1"))) == 1


def plain_strip(rows, window=13):
    first, out = {}, {}
    for k, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first.setdefault(tuple(w[a : a + window]), k) < k:
                gone[a : a + window] = [True] * window
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substrings(docs, rows, monkeypatch):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == plain_strip(rows)


def test_substrings_of_hot_anchors(docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "SHARD", 50)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(docs).collect()}
    assert got == plain_strip(rows)


def test_substrings_odd_rows(spark, empty):
    assert substrings.remove_repeats(empty).count() == 0
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.remove_repeats(odd(spark)).collect())
    assert got == sorted([("None", 0), ("None", 0), ("1", 0), ("1", 0), ("2", 40), ("3", 0), ("3", 0), ("4", 0)])


def labelled(spark):
    rng = random.Random(2)
    vocabulary = [f"wo{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for k in range(600):
        w = rng.choices(vocabulary, k=60)
        toxic, bad = int(k % 5 == 0), int(k % 7 == 0)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(60), rng.choice(("zonk", "blarg", "frumpous", "idiot")))
        if bad:
            w = [x + "$$$" for x in w]
        rows.append((k, " ".join(w)))
        if k % 4:
            labels.append((k, 1 - bad, toxic))
    rows += [(600, None), (601, ""), (None, "wo wo")]
    labels += [(None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "folds", "held", "cut"), [(toxicity, "toxic", 5, 0, 0.5), (nbsvm, "quality", 4, 2, 0.7)])
def test_classifiers_on_held_out_rows(spark, empty, module, label, folds, held, cut):
    docs, labels = labelled(spark)
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect() if r[label] is not None}
    right = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
            if r["held_out"] and r["doc_id"] in truth:
                right.append(r["predicted"] == truth[r["doc_id"]])
    assert sum(right) / len(right) > 0.95
    assert {r["doc_id"]: r["score"] for r in got} == {r["doc_id"]: r["score"] for r in module.classify(docs.repartition(4), labels.repartition(2)).collect()}
    assert module.classify(empty, labels).count() == 0 and module.classify(docs, labels.limit(0)).count() == docs.count()
