"""Classes of tokens: told apart by gaps, ordered and nested; articles that only show by that."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lociweave.llm import classes, extraction

WORDS = "stone river light under market winter garden yellow paper window silent morning table green follow".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def same_names(rng):
    """Three elements of one path, told apart only by what stands between them."""
    body = [prose(rng, 14) for _ in range(2)]
    links = "".join(f"<li><a href='/{k}'>{prose(rng, 2)}</a></li>" for k in range(4))
    page = f'<html><body><div class="c"><ul>{links}</ul></div><hr class="x"><div class="c"><h1>Of {body[0]}</h1>{"".join(f"<p>{b}</p>" for b in body)}</div><hr class="y"><div class="c">{prose(rng, 22)}</div></body></html>'
    return page, " ".join([f"Of {body[0]}", *body])


def moving(rng, k):
    """A side element comes first on a third of the pages and last on the others."""
    body = [prose(rng, 14) for _ in range(2)]
    side, main = f'<div class="s">{prose(rng, 22)}</div>', f'<div class="m"><h1>Of {body[0]}</h1>{"".join(f"<p>{b}</p>" for b in body)}</div>'
    page = f"<html><body>{side + main if k % 3 == 0 else main + side}</body></html>"
    return page, " ".join([f"Of {body[0]}", *body])


def test_articles_that_show_by_places_in_classes(spark):
    rng = random.Random(4)
    made = [(f"http://same.org/{k}", *same_names(rng)) for k in range(12)] + [(f"http://moving.org/{k}", *moving(rng, k)) for k in range(12)]
    rows = [(k, url, page) for k, (url, page, _) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[k] for k in range(len(made))] == [want for _, _, want in made]


def test_rounds_of_a_host(spark):
    rng = random.Random(5)
    rows = [(k, "http://same.org/", same_names(rng)[0]) for k in range(8)] + [(k + 8, "http://moving.org/", moving(rng, k)[0]) for k in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.xxhash64("page_id"))
    found = {r["host"]: r for r in extraction.deduced(extraction.stored(extraction.streams(df), "streams")).collect()}
    assert [f["tag"] for f in found["same.org"]["frame"]] == ["#document", "html", "body", "div", "ul", "hr", "div", "h1", "hr", "div"]
    assert [f["tag"] for f in found["moving.org"]["frame"]] == ["#document", "html", "body", "div", "h1"]


def spans(roles, tokens):
    """Instances of a class in a page as lists of places, or None where it isn't ordered."""
    at = [(p, tokens.index(r)) for p, r in enumerate(roles) if r in tokens]
    if [k for _, k in at] != list(range(len(tokens))) * (len(at) // len(tokens)):
        return None
    return [[p for p, _ in at[k : k + len(tokens)]] for k in range(0, len(at), len(tokens))]


def nested(pages, a, b):
    """Plain definition: instances of b are disjoint from those of a, or all lie in one gap of a, or a's so in b."""
    found = [(spans(p, a), spans(p, b)) for p in pages]

    def gaps(inner, outer):
        out = set()
        for s in inner:
            hit = [o for o in outer if s[0] < o[-1] and o[0] < s[-1]]
            out |= {next((k for k in range(len(o) - 1) if o[k] < s[0] and s[-1] < o[k + 1]), "crossed") for o in hit} or {"outside"}
        return out

    if not any(s[0] < o[-1] and o[0] < s[-1] for x, y in found for o in x for s in y):
        return True
    for inner, outer in ((1, 0), (0, 1)):
        seen = set().union(*(gaps(f[inner], f[outer]) for f in found))
        if len(seen) == 1 and not seen & {"crossed", "outside"}:
            return True
    return False


def test_kept_classes_are_ordered_and_nested():
    rng = random.Random(6)
    dropped = kept_in_all = 0
    for _ in range(400):
        wanted = {n: rng.sample(range(100 * n, 100 * n + 4), rng.randint(2, 4)) for n in range(1, 5)}
        pages, calm = [], rng.random() < 0.4
        for _ in range(4):
            page = list(wanted[1])
            for n in range(2, 5):
                for _ in range(rng.randint(1, 2)):
                    at = 1 if calm else rng.choice([1, 1, 1, rng.randint(0, len(page))])
                    page[at:at] = wanted[n]
            if not calm and rng.random() < 0.2:
                i = rng.randrange(len(page) - 1)
                page[i : i + 2] = page[i : i + 2][::-1]
            pages.append(page)
        given = {t: (n, k, len(c)) for n, c in wanted.items() for k, t in enumerate(c)}
        broken, counts = set(), Counter()
        for page in pages:
            b, c = classes.relations(page, given)
            broken |= b
            counts += c
        kept = defaultdict(list)
        for n, k, t, size in classes.settled([(n, k, t, s) for t, (n, k, s) in given.items()], broken, counts):
            assert k == len(kept[n]) and 2 <= size <= len(wanted[n])
            kept[n].append(t)
        assert all(spans(p, c) is not None for p in pages for c in kept.values())
        assert all(nested(pages, kept[a], kept[b]) for a in kept for b in kept if a < b)
        # what is ordered and nested with all others stays
        whole = {n: c for n, c in wanted.items() if all(spans(p, c) is not None for p in pages)}
        if len(whole) == len(wanted) and all(nested(pages, wanted[a], wanted[b]) for a in wanted for b in wanted if a < b):
            assert {n: kept[n] for n in wanted} == wanted
            kept_in_all += 1
        dropped += len(kept) < len(wanted)
    assert dropped > 50 and kept_in_all > 100


def test_roles_by_gaps():
    found = {1: (1, 0, 3), 2: (1, 1, 3), 3: (1, 2, 3), 7: (2, 0, 2), 8: (2, 1, 2)}
    roles = classes.roles_of([1, 9, 7, 9, 8, 9, 2, 9, 7, 9, 8, 3, 9], [found])
    nines = [r for t, r in zip([1, 9, 7, 9, 8, 9, 2, 9, 7, 9, 8, 3, 9], roles, strict=True) if t == 9]
    assert roles[0] == 1 and roles[2] == roles[8] == 7
    assert nines[0] == nines[2] and nines[1] == nines[4] and len(set(nines)) == 4 and nines[-1] == 9
