import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lociweave.llm import chat, jaccard, kernels, media, nbsvm, packing, rules, secrets, substrings, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = [" ", "  ", "\n", "\t", "a", "é", "日", "Ab", "'s", "1", "!", "$", "|", "<|", "\x85", " ", "　"]


def random_texts(seed, n=200, length=25):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, length))) for _ in range(n)] + ["", None, " ", "\n\n", "x"]


def test_words_and_ngrams():
    texts = random_texts(1)
    for _ in range(2):
        seen: dict[int, str] = {}
        for i, j, t in kernels.blocks(kernels.column_texts(pa.array(texts)), max_bytes=100):
            w = t.words()
            raw = t.data.tobytes()
            got = [[] for _ in range(j - i)]
            for a, z, o, h in zip(w.starts, w.ends, w.owner, w.hashes, strict=True):
                word = raw[a:z].decode()
                got[o].append(word)
                assert seen.setdefault(int(h), word) == word
            assert got == [WORD.findall(x or "") for x in texts[i:j]]
            _, at = w.ngrams(3)
            assert len(at) == sum(max(0, len(x) - 2) for x in got)
        assert len(set(seen.values())) == len(seen)
        texts = pa.array(["gap", *texts])[1:].to_pylist()


def test_long_text_is_one_block():
    long = "word " * 50_000
    found = list(kernels.blocks(kernels.column_texts(pa.array(["a", long, "b"])), max_bytes=1000))
    assert [(i, j) for i, j, _ in found] == [(0, 1), (1, 2), (2, 3)]
    w = found[1][2].words()
    assert len(w) == 50_000 and len(set(w.hashes.tolist())) == 1


def test_base_counts():
    texts = [x or "" for x in random_texts(2)] + ["a b c a b c", "x x x x x", "l\nl\n l\nl"]
    for i, j, t in kernels.blocks(kernels.column_texts(pa.array(texts)), max_bytes=200):
        got = rules.base_counts(t)
        for k, x in enumerate(texts[i:j]):
            w = WORD.findall(x)
            rows = [y for y in x.split("\n") if WORD.search(y)]
            c = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
            twice = {a + b for a in range(len(w) - 2) if c[tuple(w[a : a + 3])] > 1 for b in range(3)}
            want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(rows) - len(set(rows)), len(twice))
            assert tuple(int(got[n][k]) for n in rules._COUNTS) == want


def test_wav_round_trip_and_fingerprints():
    rng = np.random.default_rng(0)
    for n in (576, 5760):
        payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.from_wav(media.to_wav(payload)) == payload
        at, code, frames, peaks = media.peak_pairs(np.frombuffer(payload, np.uint8))
        assert frames == n // 288 - 1 and (np.diff(at) >= 0).all() and len(code) == len(at) and peaks > 0
    tone = (128 + 100 * np.sin(2 * np.pi * 40 * np.arange(5760) / 576)).astype(np.uint8)
    t, f, _, _ = media.peaks(tone)
    assert 40 in set(f.tolist())


def test_fingerprints_against_a_loop():
    rng = np.random.default_rng(11)
    for n in (576, 576 * 40):
        samples = rng.integers(0, 256, n, dtype=np.uint8)
        edges = np.linspace(2, media.BINS - 1, 5).astype(int)
        found = {}
        for k in range((n - 576) // 288 + 1):
            x = (samples[288 * k : 288 * k + 576].astype(np.float32) - 128) * media._WINDOW
            m = np.rint(np.abs(np.fft.rfft(x))).astype(int)
            for band in range(4):
                f = max(range(edges[band], edges[band + 1]), key=lambda i: (m[i], -i))
                if m[f] > m[f - 1] and m[f] > m[min(f + 1, media.BINS - 1)]:
                    found[k, band] = f
        want = []
        for (k, _), f in found.items():
            for band, distance in enumerate((1, 3, 9, 27)):
                later = [j for j, b in found if b == band and k + distance <= j]
                if later and min(later) - k <= 63:
                    want.append((k, (f << 15) | (found[min(later), band] << 6) | (min(later) - k)))
        at, code, _, peaks = media.peak_pairs(samples)
        assert sorted(want) == list(zip(at.tolist(), code.tolist(), strict=True)) and peaks == len(found)


def test_indicators_and_scores_against_a_loop():
    texts = [x or "" for x in random_texts(12, 60)] + ["Ab1 ab1 ab1 ab1", "One two. ONE two."]
    t = kernels.column_texts(pa.array(texts))
    weights = np.random.default_rng(1).normal(size=nbsvm.BUCKETS)
    model = nbsvm.Model(weights, 0.25, 0.5)
    got = [set() for _ in texts]
    for r, b in zip(*(x.tolist() for x in nbsvm.indicators(t)), strict=True):
        assert b not in got[r]
        got[r].add(b)
    for text, buckets, score in zip(texts, got, model.scores(t).tolist(), strict=True):
        raw = bytes(97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in text.encode())
        want = {((int.from_bytes(raw[k : k + n], "big") ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B % 2**32) >> 19 for n in range(1, 5) for k in range(len(raw) - n + 1)}
        w = WORD.findall(text)
        want |= {0} if any(a == b == c for a, b, c in zip(w, w[1:], w[2:])) else set()  # noqa: B905
        assert {b for b in buckets if b < nbsvm.FORM_BUCKETS} == want
        lower = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in w]
        words = {int(kernels.column_texts(pa.array([" ".join(lower[k : k + n])])).words().ngrams(n)[0][0] >> np.uint64(49)) for n in (1, 2) for k in range(len(w) - n + 1)}
        assert {b - nbsvm.FORM_BUCKETS for b in buckets if b >= nbsvm.FORM_BUCKETS} == words
        margin = sum(weights[b] for b in buckets) + 0.25
        assert score == pytest.approx(1 / (1 + np.exp(-(0.5 * margin + np.log(0.7 / 0.3)))))


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "a\\b<|im_end|>\n<|im_start|>x", "<", "\\", "<\\|", "\\n\n", "<|<|", "é日"])
def test_chat_round_trip(text):
    formatted, a, z = chat.render_message("assi\nstant<|", text)
    assert chat.parse_message(formatted) == ("assi\nstant<|", text)
    assert chat.unescape(formatted[a:z]) == text and formatted.count("<|im_end|>") == 1


def test_tokens_equal_the_whole_text():
    texts = [x or "" for x in random_texts(3, 400)] + ["don't  we'll\r\nx", "<|endoftext|> a", "a.\nb c"]
    coder = packing.ChunkEncoder(packing.default_tokenizer())
    ids, counts = coder.encode(kernels.column_texts(pa.array(texts)), 2)
    want = [x.ids + [2] for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_generations_of_the_dictionary(monkeypatch):
    monkeypatch.setattr(packing, "ENTRIES", 40)
    monkeypatch.setattr(packing, "SLOT_BITS", 6)
    monkeypatch.setattr(packing, "_SLOT_MASK", np.uint64(63))
    rng = random.Random(5)
    coder = packing.ChunkEncoder(packing.default_tokenizer())
    for k in range(30):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 90))) for _ in range(4)]
        ids, counts = coder.encode(kernels.column_texts(pa.array(texts)), 2)
        want = [x.ids + [2] for x in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert coder.young.entries <= 40 and coder.old.entries <= 40


def test_sweep_packs_as_best_fit_decreasing():
    import bisect

    rng = np.random.default_rng(4)
    for most in (1024, 400, 30):
        lengths = rng.integers(1, most + 1, 700)
        counts = Counter(lengths.tolist())
        bins: dict[int, list] = {}
        ranks = Counter()
        for length, first, m, b, offset in packing.sweep(counts):
            assert first == ranks[length]
            ranks[length] += m
            for k in range(m):
                bins.setdefault(b + k, []).append((offset, length))
        assert ranks == counts
        for v in bins.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= 1024
        gaps: list[int] = []
        for length in sorted(lengths.tolist(), reverse=True):
            k = bisect.bisect_left(gaps, length)
            gap = gaps.pop(k) if k < len(gaps) else 1024
            bisect.insort(gaps, gap - length)
        assert len(bins) == len(gaps)


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(5)
    for symbols in (2, 5, 70):
        s = rng.integers(0, symbols, 500)
        tree = substrings.WaveletTree(s, symbols)
        c, i = rng.integers(0, symbols, 300), rng.integers(0, 501, 300)
        assert tree.rank(c, i).tolist() == [int((s[:k] == x).sum()) for x, k in zip(c, i, strict=True)]


def test_matches_and_repeated_windows():
    rng = np.random.default_rng(6)
    for window in (3, 5):
        seqs = [rng.integers(1, 4, rng.integers(window, window + 9)).astype(np.uint64) for _ in range(60)]
        docs = rng.integers(0, 30, 60)
        sizes = np.array([len(x) for x in seqs])
        low: dict = {}
        for x, d in zip(seqs, docs, strict=True):
            for k in range(len(x) - window + 1):
                key = tuple(x[k : k + window].tolist())
                low[key] = min(low.get(key, 99), int(d))
        want = [low[tuple(x[k : k + window].tolist())] for x in seqs for k in range(len(x) - window + 1)]
        assert substrings.repeated(np.concatenate(seqs), sizes, docs, window).tolist() == want


def test_every_window_is_in_one_segment():
    texts = [" ".join(random.Random(k).choices("abcd", k=n)) for k, n in enumerate((0, 3, 12, 13, 14, 80, 400))] + ["z " * 500]
    w = kernels.column_texts(pa.array(texts)).words()
    anchor, first, count = substrings.anchored(w, 13, 4)
    assert count.max() <= substrings.LONGEST
    covered = sorted(x for f, c in zip(first.tolist(), count.tolist(), strict=True) for x in range(f, f + c))
    base, want = 0, []
    for n in w.counts.tolist():
        want += list(range(base, base + max(0, n - 12)))
        base += n
    assert covered == want
    h, at = w.ngrams(13)
    by_window: dict = {}
    of = {x: a for f, c, a in zip(first.tolist(), count.tolist(), anchor.tolist(), strict=True) for x in range(f, f + c)}
    for x, p in zip(h.tolist(), at.tolist(), strict=True):
        assert by_window.setdefault(x, of[p]) == of[p]


def test_marks_leave_two_owners():
    rng = np.random.default_rng(14)
    shared, plain = kernels.Shared(), {}
    marked = 0
    for _ in range(40):
        owner = np.repeat(np.arange(30) + rng.integers(0, 1 << 40), 6)
        value = np.where(rng.random(180) < 0.3, rng.integers(0, 5, 180), rng.integers(5, 1 << 30, 180)).astype(np.uint64)
        sure = shared.marks(value, owner)
        marked += int(sure.sum())
        for v, o in zip(value[~sure].tolist(), owner[~sure].tolist(), strict=True):
            plain.setdefault(v, set()).add(o)
        assert all(len(plain[v]) > 1 for v in value[sure].tolist())
    assert marked > 1000 and max(map(len, plain.values())) < 8
    assert kernels.Shared().marks(value[:0], owner[:0]).tolist() == []


def test_point_bounds_hold():
    rng = np.random.default_rng(7)
    for _ in range(50):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = np.unique(rng.choice(pool, 150)), np.unique(rng.choice(pool, 150))
        p, q = jaccard.points([jaccard.point(a), jaccard.point(b)])
        shared = len(np.intersect1d(a, b))
        assert shared <= np.minimum(p, q).sum() <= np.minimum(*jaccard.coarse(np.stack([p, q]))).sum()
    huge = np.arange(300_000, dtype=np.uint64) << np.uint64(16)
    assert jaccard.points([jaccard.point(huge)]).sum() == len(huge)
    for n in range(1, 200):
        assert n - jaccard.prefix_length(n, 85) + 1 == -(-85 * n // 100)


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(8)
    p = rng.poisson(2, (400, jaccard.GROUPS)).astype(np.uint32)
    p[200:] = p[:200] + (rng.random((200, jaccard.GROUPS)) < 0.05)
    n = p.sum(axis=1).astype(np.int64)
    for size in (100, 400):
        tree = jaccard.RTree(p[:size], n[:size])
        i, j = tree.join(p, n, 85)
        want = {(a, b) for a in range(400) for b in range(size) if 100 * min(n[a], n[b]) >= 85 * max(n[a], n[b]) and jaccard.can_link(np.minimum(p[a], p[b]).sum(), n[a], n[b], 85)}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > size


def test_candidates_and_examples():
    texts = ['token = "ab12ab12ab12ab12ab12" x', "no secrets here", "é 1234567890123456", None, "CamelCaseIdentifierName", "short1"]
    row, starts, ends = secrets.candidate_spans(kernels.column_texts(pa.array(texts)))
    assert row.tolist() == [0, 2, 4] and (ends - starts).tolist() == [20, 16, 23]
    for text, a, z, label in secrets.example_findings(50):
        assert len(secrets.describe(text[a:z], text[:a], text[z:])) == len(secrets.FEATURES) and label in (0, 1)
    assert secrets.example_findings(50) == secrets.example_findings(50)


def found_candidates(text):
    spans = secrets.candidate_spans(kernels.column_texts(pa.array([text])))
    return [text.encode()[a:z].decode() for _, a, z in zip(*(x.tolist() for x in spans), strict=True)]


def test_candidates_against_a_loop():
    rng = random.Random(13)
    inside = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.-")
    for _ in range(300):
        text = "".join(rng.choice(("aB3dE5", "xyz", "=", "==", " ", "\n", "é", ".", "/", "1", "Q", ",")) for _ in range(rng.randint(0, 40)))
        want, k = [], 0
        while k < len(text):
            z = k
            while z < len(text) and text[z] in inside:
                z += 1
            pad = z
            while pad < len(text) and text[pad] == "=":
                pad += 1
            end = pad if pad == len(text) or text[pad] not in inside else z
            value = text[k:end].rstrip(".") if end > z else text[k:z].rstrip(".")
            if len(value) >= secrets.LEAST and re.search(r"[0-9]|[a-z][A-Z]", value):
                want.append(value)
            k = max(pad, z, k + 1) if pad > z or z > k else k + 1
        assert found_candidates(text) == want


def test_candidates_of_assignments():
    value = "Ab3xYz9QwErTy12345Kk"
    for form in ("api_key={}", "export TOKEN={} ", "a\nSECRET={}\nb=1", "https://x.com/a?access_token={}&b=1", "see {}. Then", "API_KEY==={}"):
        assert found_candidates(form.format(value)) == [value]
    assert found_candidates(f"token={value}==") == [f"{value}=="]
    short = {'password = "hunter2!x" ok': "hunter2!x", "pwd=S3cr3t!, then": "S3cr3t!", "dbPassword: pässwört1 é": "pässwört1", '{"apiKey":"abc!1234"}': "abc!1234", "Authorization: Bearer abc12345": "abc12345"}
    assert {text: found_candidates(text) for text in short} == {text: [value] for text, value in short.items()}
    assert not any(map(found_candidates, ("password: required now", "password=", "====", "a=b", "name = hunter2!x")))
    for text, a, z, _ in secrets.example_findings(200):
        assert text[a:z] in found_candidates(text)


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(9)
    rows = [np.unique(np.append(rng.integers(100, 200, 5), 1 if k % 2 else 2)) for k in range(200)]
    y = np.arange(200) % 2
    w, b = nbsvm.dual_coordinate_descent(rows, y, nbsvm.log_count_ratios(rows, y), 1.0, 20)
    assert all((w[x].sum() + b > 0) == label for x, label in zip(rows, y, strict=True))


def test_label_model_recovers_rates():
    rng = np.random.default_rng(10)
    y = rng.random(20_000) < 0.2
    strong = np.linspace(0.9, 0.5, toxicity.VOTERS)
    spoke = rng.random((len(y), toxicity.VOTERS)) < np.where(y[:, None], strong, 0.02)
    patterns = spoke @ (1 << np.arange(toxicity.VOTERS))
    used, counts = np.unique(patterns, return_counts=True)
    model = toxicity.LabelModel(used, counts, patterns[:100], y[:100].astype(int))
    assert np.abs(model.toxic - strong).max() < 0.1 and model.other.max() < 0.06
    assert ((model.posterior(patterns) > 0.5) == y).mean() > 0.97


def test_label_model_counts_a_copied_voter_once():
    rng = np.random.default_rng(11)
    y = rng.random(20_000) < 0.2
    spoke = rng.random((len(y), toxicity.VOTERS)) < np.where(y[:, None], 0.6, 0.03)
    spoke[:, 1:4] = spoke[:, :1]
    patterns = spoke @ (1 << np.arange(toxicity.VOTERS))
    used, counts = np.unique(patterns, return_counts=True)
    model = toxicity.LabelModel(used, counts, patterns[:200], y[:200].astype(int))
    copies = [i for i in range(1, 4) if model.neighbour[i] in range(4)]
    assert copies == [1, 2, 3]  # the tree joins the copies
    assert all(abs(model.evidence[i][v, v]) < 0.1 for i in copies for v in (0, 1))
    assert ((model.posterior(patterns) > 0.5) == y).mean() > 0.97


def test_forms_stay_within_texts():
    texts = ["so!", "!a", "heyyy", "hey", "yy", "y", "", "a*b", "a*", "b", "ABC d", "$", None, "é" * 3]
    got = list(zip(*(x.tolist() for x in toxicity.forms(kernels.column_texts(pa.array(texts, pa.string()))))))
    alone = [tuple(x.tolist()[0] for x in toxicity.forms(kernels.column_texts(pa.array([t], pa.string())))) for t in texts]
    assert got == alone
    assert [t for t, x in zip(texts, got) if x[3]] == ["heyyy"] and [t for t, x in zip(texts, got) if x[4]] == ["a*b"]
    assert not any(x[2] for x in got) and [t for t, x in zip(texts, got) if x[0]] == ["ABC d"]
