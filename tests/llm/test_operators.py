"""The training-data operators against brute force, and the cases their docstrings state."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import bpe, crf, exact_dedup, langid, line_dedup, merkle, mixing, queries, simhash, toxicity, url_filter, warc
from textloom.llm.components import components

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, at string, digest string, size int"


def docs(spark, rows):
    """(doc_id, text, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "a", "d", 1) for i, t, s in rows], DOCS)


ODD = [(5, "a  b", "s"), (3, "a\tb", "s"), (3, "a\tb", "s"), (9, None, None), (8, "", "t"), (None, "a b", "s"), (7, "w " * 3000, "t"), (6, "Á b\x0bc", None)]


def load(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_url_filter(spark):
    urls = ["http://A.example.org/es/x?q", "https://example.org", "ftp://x.org/a#b", None, "no scheme", "http://b.com/de/", "http://com/fr/1", "http://notorg/", "http://example.org/en/1", "http://example.org/en/12"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame([*queries.URL_RULES, ("org", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    for i, url in enumerate(urls):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0].lower()
            path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, *(max(fits)[2:] if fits else (None, "allow")))
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filter_of_many_shapes_and_odd_rows(spark):
    """Rules of many path lengths in one plan; repeated rows, null ids, rules of equal length."""
    rules = [("site.org", "/" + "d" * n, "block" if n % 2 else "allow") for n in range(300)] + [("a.site.org", "/dd", "allow"), ("site.org", "/ddaa", "block"), ("x.site.org", "/d", "allow")]
    urls = [(i, f"http://{h}/{'d' * (i % 350)}/t") for i, h in enumerate(["site.org", "a.site.org", "x.site.org", ".site.org", "site.org.", "org"] * 60)]
    urls += [(None, "http://site.org/d"), (None, "http://site.org/d"), (None, None), (1, "http://" + "a." * 5000 + "site.org/d")]
    got = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    wanted = []
    for i, url in urls:
        host, path = (url.split("://")[1].split("/", 1)[0], "/" + url.split("://")[1].split("/", 1)[1]) if url else ("", "")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        wanted.append((i, host, path, *(max(fits)[2:] if fits else (None, "allow"))))
    assert Counter(map(tuple, got)) == Counter(wanted)


def test_bloom_has_no_false_negatives(spark):
    h = spark.range(5000).select(F.xxhash64("id").alias("h"))
    filled, _ = url_filter.blooms(h)
    assert url_filter.may_hold(filled, np.array([r.h for r in h.collect()])).all()
    other = np.array([r.h for r in spark.range(5000, 10000).select(F.xxhash64("id").alias("h")).collect()])
    assert url_filter.may_hold(filled, other).mean() < 0.05


def test_edit_distance_and_keys():
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            if rng.random() < 0.5:
                b.insert(i, rng.choice("abc"))
            elif b:
                b.pop(min(i, len(b) - 1))
        b = "".join(b)
        for most in (1, 2, 3):
            assert line_dedup.edit_distance(a, b, most) == line_dedup.edit_distance(list(a), list(b), most) == min(distance(a, b), most + 1)


def near(a, b):
    """The definition of near-equal lines, by full edit distances."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in (a, b)]
    chars, most = min(2, min(len(a), len(b)) // 10), min(3, min(map(len, words)) // 10)
    return abs(len(a) - len(b)) <= chars and distance(a, b) <= chars or 0 < most >= abs(len(words[0]) - len(words[1])) and distance(*words) <= most


def edited(rng, symbols, edits, alphabet):
    symbols = list(symbols)
    for _ in range(edits):
        i, kind = rng.randint(0, len(symbols)), rng.randrange(3)
        if kind == 0:
            symbols.insert(i, rng.choice(alphabet))
        elif kind == 1:
            symbols[i : i + 1] = []
        else:
            symbols[i : i + 1] = [rng.choice(alphabet)]
    return symbols


def test_near_lines_share_a_key():
    rng, vocabulary = random.Random(6), ["a", "bc", "def", "ghij", "é", "no"]
    pairs = []
    for _ in range(1000):
        line = [rng.choice("ab ") for _ in range(rng.randint(8, 45))]
        pairs.append(("".join(line), "".join(edited(rng, line, rng.randint(0, 3), "ab "))))
        line = [rng.choice(vocabulary) for _ in range(rng.randint(8, 70))]
        pairs.append((" ".join(line), "  ".join(edited(rng, line, rng.randint(0, 4), vocabulary))))
    lines = line_dedup.Lines([x for p in pairs for x in p])
    key, line, own = lines.keys()
    met, probed = [set() for _ in lines.chars], [set() for _ in lines.chars]
    for k, n, o in zip(key.tolist(), line.tolist(), own.tolist()):
        probed[n].add(k)
        if o:
            met[n].add(k)
    found = 0
    for i, (a, b) in enumerate(pairs):
        assert line_dedup.near_lines_of(a, b) == near(a, b)
        if a != b and near(a, b):
            found += 1
            assert met[2 * i] & probed[2 * i + 1] or met[2 * i + 1] & probed[2 * i]
    assert found > 400


def line_classes(rows):
    """All pairs of different lines, for rows with distinct ids; test_near_lines_share_a_key holds near_lines_of against full distances."""
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        for n, line in enumerate(t.split("\n") if t is not None else []):
            first.setdefault(line, (i, n))
    group = {x: x for x in first}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    real = sorted(x for x in first if x.strip(line_dedup.BLANK))
    for i, a in enumerate(real):
        for b in real[i + 1 :]:
            if top(a) != top(b) and line_dedup.near_lines_of(a, b):
                group[top(a)] = top(b)
    head, texts = {}, Counter(map(top, first))
    for x in first:
        head[top(x)] = min(head.get(top(x), first[x]), first[x])
    return {(i, n): ((i, n), 1) if not x.strip(line_dedup.BLANK) else (head[top(x)], texts[top(x)]) for i, t, _ in rows if t is not None for n, x in enumerate(t.split("\n"))}


def decided(spark, rows):
    return {(r.doc_id, r.no): ((r.class_key, r.class_no), r.class_texts) for r in line_dedup.decide(docs(spark, rows)).collect()}


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog"
    rows = [(1, f"{base}\nshort\n\n{base}!", "a"), (2, f"short\n{base[:20]}X{base[20:]}\nnew line of this document", "a"), (3, None, "b"), (4, "", "b"), (5, base.replace("quick", "quack") + "\nfresh\nshort", "b"), (6, "x" * 30000, "c")]
    rows += [(7, "nineteen letters ok\nnineteen letterz ok\n" + "\u00a0" * 12 + "\n" + "\u00a0" * 13, "c"), (8, " ".join(f"w{i}" for i in range(30)), "c"), (9, " ".join(f"w{i}" if i % 12 else "another" for i in range(30)), "c")]
    wanted = line_classes(rows)
    assert decided(spark, rows) == wanted
    assert wanted[7, 1] == ((7, 0), 2) and wanted[7, 3] == ((7, 2), 2) and wanted[9, 0] == ((8, 0), 2)
    cleaned = {r.doc_id: (r.text, r.n_chars, r.at) for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert cleaned[2][0] == "new line of this document" and cleaned[5][0] == "fresh" and cleaned[3][0] is None
    assert all(n == len(t or "") and at == "a" for t, n, at in cleaned.values())
    assert line_dedup.dedup(docs(spark, ODD)).count() == len(ODD)
    assert line_dedup.decide(docs(spark, [])).count() == 0


def test_line_dedup_of_a_large_group(spark):
    rng, base = random.Random(8), "an order was placed at the counter by the customer"
    lines = ["".join(edited(rng, base, rng.randint(0, 4), "abc ")) for _ in range(300)]
    lines += [f"{base} {''.join(rng.choice('abcdefgh') for _ in range(9))}" for _ in range(150)]  # one common segment
    rows = [(i, x, "s") for i, x in enumerate(lines)]
    assert decided(spark, rows) == line_classes(rows)
    links = line_dedup.near_lines(docs(spark, rows))
    assert links.count() < 3 * len(lines)


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}" if i % 4 else None) for i in range(60)]
    sized = mixing.sizes(docs(spark, rows))
    got = mixing.assign(sized, key="doc_id", source="source", size="size").toPandas()
    total = got["size"].sum()
    per = got.groupby(got.source.fillna("~null")).agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    targets = {s: 0.0 for s in sorted(per.index)}
    weight, left = dict(zip(targets, [5, 2, 1] * 2)), 1.5 * total
    open_sources = set(targets)
    while True:  # resharing, round by round
        share = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        over = {s for s in open_sources if share[s] > 2 * per["size"][s]}
        if not over:
            break
        for s in over:
            targets[s] = 2.0 * per["size"][s]
            left -= targets[s]
        open_sources -= over
    targets |= share
    for s in targets:
        assert per.told[s] == per["size"][s] and per.target[s] == pytest.approx(targets[s]) and abs(per.taken[s] - targets[s]) <= 0.5 + 1e-6
    assert (got.taken <= 2 * got["size"]).all()
    mixed = mixing.mix(docs(spark, rows))
    assert mixed.columns == docs(spark, rows).columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == got.taken.sum()
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.assign(mixing.sizes(docs(spark, ODD)), key="doc_id", source="source", size="size").count() == len(ODD)


def test_mixing_of_null_keys_and_ranges(spark, monkeypatch):
    rows = [(None, "w " * (i % 9), f"s{i % 2}") for i in range(400)] + [(i, "w " * (i % 5), "s0") for i in range(100)]
    sized = mixing.sizes(docs(spark, rows))
    run = lambda d: Counter(map(tuple, mixing.assign(d, key="doc_id", source="source", size="size").collect()))
    few = run(sized)
    assert sum(few.values()) == 500 and few == run(sized.repartition(5))
    for _, source, _, told, target, _ in few:
        assert abs(sum(r[5] * n for r, n in few.items() if r[1] == source) - target) <= 0.5 + 1e-6
    monkeypatch.setattr(mixing, "RANGE_DIGITS", 1)
    assert run(sized) == few  # however many ranges
    assert [mixing.range_digits(n) for n in (0, 16 * 20_000, 16 * 20_000 + 1)] == [1, 1, 2]
    assert run(sized.limit(0)) == Counter()


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emission, counts = rng.normal(size=(205, 3)), np.array([0, 130, 1, 0, 64, 10])
    move, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    got, pairs = crf.marginals(emission, counts, move, start, pairs=True)
    wanted, at, expected = [], 0, np.zeros((3, 3))
    for n in counts[counts > 0]:
        e = emission[at : at + n]
        at += n
        a, b = [start + e[0]], [np.zeros(3)]
        for t in range(1, n):
            a.append(np.logaddexp.reduce(a[-1][:, None] + move, axis=0) + e[t])
        for t in range(n - 1, 0, -1):
            b.insert(0, np.logaddexp.reduce(move + e[t] + b[0], axis=1))
        z = np.logaddexp.reduce(a[-1])
        wanted += [np.exp(x + y - z) for x, y in zip(a, b)]
        expected += sum((np.exp(a[t - 1][:, None] + move + e[t] + b[t] - z) for t in range(1, n)), np.zeros((3, 3)))
    assert np.allclose(got, wanted) and np.allclose(pairs, expected)


def test_language(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = source.withColumn("held_out", F.lit("clash"))
    got = langid.predict(both, queries.fold(3) == 1).join(source.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    odd = langid.predict(docs(spark, ODD).withColumn("lang", F.lit(None).cast("string")), F.lit(False)).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)} and len(odd) == len(ODD)
    rows = langid.predict(docs(spark, [(1, "eins zwei", "s"), (2, "123 --", "s"), (3, None, "s")]), F.lit(False)).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {1: "en", 2: "und", 3: "und"}


def test_simhash(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = [(100, " ".join(base), "s"), (50, " ".join(base).upper(), "s"), (1, None, "s"), (2, "", "s"), (None, "  ", "s"), (3, "one two", "s"), (3, "one two", "s")]
    for i in range(4, 30):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(300)] = "x"
        rows.append((i, " ".join(words), "s"))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(20)), "s") for i in range(200, 260)]

    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        bits = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))

    fp = [brute(t) for _, t, _ in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                group[top(i)] = top(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[top(i)] = min(smallest.get(top(i), r[0]), r[0])
    wanted = Counter((r[0], f"{fp[i]:016x}", smallest[top(i)]) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs(spark, rows)).collect()) == wanted
    kept = simhash.dedup(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(smallest.values())) and kept.columns[-1] == "size"
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_links_are_complete(spark):
    rng = random.Random(3)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(63), k)) for v in values[:30] for k in (1, 2, 3, 4, 5)]
    values = list(dict.fromkeys(values))
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    group = {v: v for v in values}

    def top(v):
        while group[v] != v:
            v = group[v]
        return v

    for i, x in enumerate(values):
        for y in values[:i]:
            if ((x ^ y) & (1 << 64) - 1).bit_count() <= 4:
                group[top(x)] = top(y)
    roots = {r.node: r.root for r in components(spark.createDataFrame(found), "x", "y").collect()}
    least = {}
    for v in sorted(values):
        least.setdefault(top(v), v)
    assert {v: roots.get(v, v) for v in values} == {v: least[top(v)] for v in values}
    assert all(((r.x ^ r.y) & (1 << 64) - 1).bit_count() <= 4 for r in found)


def plan_of(monkeypatch, label, run):
    """The plan by which `run` makes the table `label`."""
    plans, keep = [], simhash.written
    monkeypatch.setattr(simhash, "written", lambda df, at: plans.append((at, df._jdf.queryExecution().executedPlan().toString())) or keep(df, at))
    run()
    return next(plan for at, plan in plans if at == label)


def test_the_index_of_sets_is_not_broadcast(spark, monkeypatch):
    # As a table this is small enough to broadcast; of its 192 variants a row Spark's estimate knows nothing.
    sets = simhash.written(spark.range(200).selectExpr("id s", "id w0", "-id w1", "id * 7 w2", "100L n"), "sets")
    plan = plan_of(monkeypatch, "met-sets", lambda: simhash.close_sets(sets))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_index_of_fingerprints_is_not_broadcast(spark, monkeypatch):
    distinct = simhash.written(spark.range(200).selectExpr("id * 1234567891011 fp"), "fingerprints")
    plan = plan_of(monkeypatch, "met-fingerprints", lambda: simhash.links(distinct))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_similar(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(2000)]
    rows = [(900, None, "s"), (901, "", "s"), (None, " ", "s"), (902, "one two", "s"), (903, "ONE  two", "s"), (903, "ONE  two", "s"), (None, "three", "s")]
    for i in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((12, 60, 150, 400)))]
        rows.append((10 * i, " ".join(base), "s"))
        for j in range(1, 5):
            words = list(base)
            for _ in range(max(1, len(words) * j // 100)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((10 * i + j, " ".join(words), "s"))

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t, _ in rows]
    share = {(i, j): (len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0) for i in range(len(rows)) for j in range(i)}
    wanted = {p for p, x in share.items() if x >= 0.8}
    assert sum(x < 0.9 for p, x in share.items() if p in wanted) >= 20

    def groups(pairs):
        group = list(range(len(rows)))

        def top(i):
            while group[i] != i:
                i = group[i]
            return i

        for i, j in pairs:
            group[top(i)] = top(j)
        return [top(i) for i in range(len(rows))]

    true = groups(wanted)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, rows)).collect() if r.doc_id is not None}
    keyed = [i for i, r in enumerate(rows) if r[0] is not None]
    smallest = {g: min(rows[i][0] for i in keyed if true[i] == g) for g in {true[i] for i in keyed}}
    # No text is joined that no chain of real links joins, and few real groups fall apart.
    assert all(true[i] == true[j] for i in keyed for j in keyed if got[rows[i][0]] == got[rows[j][0]])
    missed = [i for i in keyed if got[rows[i][0]] != smallest[true[i]]]
    assert len(missed) <= 0.02 * len(keyed)
    assert all(got[rows[i][0]] == got[rows[j][0]] for (i, j), x in share.items() if x >= 0.9 and i in keyed and j in keyed)
    assert got[900] == got[901] == 900 and got[903] == 902
    kept = simhash.dedup(docs(spark, rows), groups=simhash.similar)
    # The text that only a null key has stays too.
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*set(got.values()), None]) and kept.columns[-1] == "size"
    assert simhash.similar(docs(spark, [])).count() == 0


@pytest.mark.parametrize("groups", [simhash.near_duplicates, simhash.similar])
def test_dedup_keeps_a_row_of_each_component(spark, groups):
    rows = [(None, None, "s"), (None, "alpha beta gamma delta epsilon zeta", "s"), (None, "one two three four five six", "s"), (None, "ONE two three four five six", "s")]
    rows += [(7, "red green blue black white grey", "s"), (7, "iron gold tin lead zinc copper", "s"), (7, "iron gold tin lead zinc copper", "s"), (8, "iron  gold tin lead zinc copper", "s")]
    kept = Counter((r.doc_id, " ".join((r.text or "").lower().split())) for r in simhash.dedup(docs(spark, rows), groups=groups).collect())
    assert kept == Counter([(None, ""), (None, rows[1][1]), (None, rows[2][1]), (7, rows[4][1]), (7, rows[5][1])])


def test_similar_measures_texts_of_equal_fingerprints(spark):
    rng, rows = random.Random(11), []
    for i in range(60):
        words = [f"q{rng.randrange(10**6)}" for _ in range(7)]
        rows += [(3 * i, " ".join(words[:6]), "s"), (3 * i + 1, " ".join(words[:5] + words[6:]), "s"), (3 * i + 2, " ".join(words[:5]), "s")]
    fingerprints = [simhash.set_fingerprint(t)[0] for _, t, _ in rows]
    assert len(set(fingerprints)) < len(rows) - 20
    # Shares of 1/3 and 1/2 are no links.
    assert all(r.component_id == r.doc_id for r in simhash.similar(docs(spark, rows)).collect())
    assert simhash.dedup(docs(spark, rows), groups=simhash.similar).count() == len(rows)


@pytest.mark.parametrize("common, left, right", [(4, 0, 1), (8, 0, 2), (16, 2, 2), (64, 0, 16)])
def test_similar_finds_all_pairs_of_small_sets(spark, common, left, right):
    rng, rows = random.Random(12), []
    for i in range(150):
        words = [f"q{rng.randrange(10**6)}" for _ in range(common + 4)]
        more = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(2 * i, " ".join(words + more(left)), "s"), (2 * i + 1, " ".join(words + more(right)), "s")]
    got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, rows)).collect()}
    assert got == {i: i - i % 2 for i in got} and len(got) == len(rows)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 13], "a long, b long")
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert got[12 + 1] == 1 and got[26] == 14 and len(set(got.values())) == 5
    assert components(links.limit(0), "a", "b").count() == 0


def test_merkle(spark):
    rows = [(i, t, "s") for i, t in enumerate(["One. Two two.\nThree three. Four.", "", None, "abc", "One. Two two.\nThree three. Four!", "é" * 999 + "\n" + "x. " * 400])]
    rows += [(100 + i, f"para {i}.\n" * (i % 5), "s") for i in range(40)]
    got = {r.doc_id: r for r in merkle.compare_with_next(docs(spark, rows)).collect()}
    ids = sorted(got)
    by_id = {i: t or "" for i, t, _ in rows}
    assert ids == sorted(by_id)
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, u = by_id[i], by_id[after]
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (t == new) and (r.fingerprint == got[after].fingerprint) == (t == u)
        assert (r.near_edited == 1) == (t == new) and (r.near_next == 1) == (t == u) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    a, b = merkle.tree("One. Two.\nThree.\n"), merkle.tree("One. Two!\nThree.\n")
    assert merkle.edits(a, b) == [(4, 10)] or merkle.edits(a, b)[0][0] == 4
    assert merkle.compare_with_next(docs(spark, ODD)).count() == len(ODD)
    assert merkle.compare_with_next(docs(spark, [])).count() == 0
    single = merkle.compare_with_next(docs(spark, [(1, "ab", "s")])).first()
    assert single.near_next == 1.0


def test_exact_dedup(spark):
    got = exact_dedup.decide(docs(spark, ODD)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter([(5, 3, 4, False), (3, 3, 4, True), (3, 3, 4, False), (None, 3, 4, False), (9, 8, 2, False), (8, 8, 2, True), (7, 7, 1, True), (6, 6, 1, True)])
    assert sorted(r.doc_id for r in exact_dedup.dedup(docs(spark, ODD)).collect()) == [3, 6, 7, 8]
    assert exact_dedup.decide(docs(spark, [])).count() == 0
    many = [(i, "same" if i % 3 else f"t{i}", "s") for i in range(300)]
    got = exact_dedup.decide(docs(spark, many), counters=8, most=2).collect()
    assert all((r.keep_id, r.group_size) == ((1, 200) if r.doc_id % 3 else (r.doc_id, 1)) for r in got)


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 9))]
        tree, out = warc.LoserTree(), []
        for run in runs:
            tree.add(run)
        while tree.peek() is not None:
            out.append(tree.pop())
        assert out == sorted(sum(runs, []))


def test_warc(spark):
    rows = [(1, "http://a.b/x y\r\nz", "<p>é\r\n\r\n</p>"), (5, None, None), (2, "http://www.A.b/", "<p>é\r\n\r\n</p>"), (3, "u", ""), (4, "http://a.b/", "<p>é\r\n\r\n</p>"), (None, "http://q", "q"), (7, "http://a.b/", "WARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, key string")
    got = warc.capture_history(pages).toPandas()
    order = got.sort_values(["range", "position"])
    assert list(order.url_key) == sorted(order.url_key)
    for r in got.itertuples():
        html = next((h or "") for i, _, h in rows if i == r.page_id or (i is None and r.page_id != r.page_id)).encode()
        same = [i for i, _, h in rows if (h or "").encode() == html and i is not None]
        assert r.payload_bytes == len(html) and r.payload_digest == base64.b32encode(hashlib.sha1(html).digest()).decode()
        if same and r.page_id != max(same):
            assert r.record_type == "revisit" and r.refers_to == max(same)
        else:
            assert r.record_type == "response" and r.refers_to != r.refers_to
    assert {r.record_type for r in warc.capture_history(pages, least=1000).collect()} == {"response"}
    assert warc.capture_history(pages.limit(0)).count() == 0


def test_warc_of_a_key_with_several_payloads(spark):
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (1, "http://c", "y"), (3, "http://d", "y"), (1, "http://e", "z")]
    got = warc.capture_history(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    wanted = [(1, "x", "revisit", 2), (2, "x", "response", None), (1, "y", "revisit", 3), (3, "y", "response", None), (1, "z", "response", None)]
    found = [(r.page_id, r.payload_digest, r.record_type, None if r.refers_to != r.refers_to else r.refers_to) for r in got.itertuples()]
    assert Counter(found) == Counter((k, digest(t), kind, refers) for k, t, kind, refers in wanted)


def test_warc_files_by_size(spark):
    rows = [(i, f"http://a/{i}", "x" * n, 0) for i, n in enumerate([10, 200, 200, 5000, 7, 5000, 6000, 90_000])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = warc.shared_path(spark, "sizes")
    warc.write(pages, path, files=((100, 3), (5000, 2), (None, 1)))
    got = warc.read(spark, path).toPandas()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert Counter(zip(got.key, got.payload_bytes, got.payload_digest)) == Counter((str(i), len(t), digest(t)) for i, _, t, _ in rows)
    large = got[got.payload_bytes > 5000]
    assert large.archive.nunique() == len(large) and len(got[got.record_type == "revisit"]) == 2


def test_toxicity(spark):
    source = "/root/testdata/sf0.1"
    texts, labels = spark.read.parquet(f"{source}/documents.parquet"), spark.read.parquet(f"{source}/labels.parquet")
    got = toxicity.predict(texts, labels, queries.fold(5) == 0).where("held_out").join(labels, "doc_id").toPandas()
    caught, cleared = got[got.toxic == 1].predicted.mean(), 1 - got[got.toxic == 0].predicted.mean()
    assert caught > 0.9 and cleared > 0.97
    assert toxicity.predict(docs(spark, ODD), labels.limit(0), F.lit(False)).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.reject(docs(spark, ODD), labels.limit(0), F.lit(False)).columns == docs(spark, ODD).columns


def test_swap_penalty_and_its_gradient():
    rng = np.random.default_rng(3)
    sentences = [[0, 1, 2], [3, 1], [4, 2, 5, 0], [6], [1, 5]]
    at, of = np.concatenate([np.array(x) for x in sentences]), np.repeat(np.arange(5), [len(x) for x in sentences])
    pairs = [(1, 2), (2, 1), (5, 7), (7, 5), (1, 8)]
    swaps = toxicity.swapped(at, of, pairs)
    wanted = [(i, t, o, o in x) for i, x in enumerate(sentences) for w in x for t, o in pairs if t == w]
    assert Counter(zip(*(x.tolist() for x in swaps))) == Counter(wanted)

    def penalty(word, bias):
        """By definition: every swapped sentence is made and scored."""
        score = lambda x: 1 / (1 + np.exp(-(bias + sum(word[w] for w in x))))
        return np.mean([(score(sentences[i]) - score((set(sentences[i]) - {t}) | {o})) ** 2 for i, t, o, _ in wanted])

    def all_of(word, bias):
        return toxicity.swap_penalty(word, np.bincount(of, word[at], 5) + bias, at, of, swaps)

    word, bias, step = rng.normal(size=9), 0.3, 1e-6
    value, by_word, by_bias = all_of(word, bias)
    assert value == pytest.approx(penalty(word, bias))
    for w in range(9):
        moved = word.copy()
        moved[w] += step
        assert (penalty(moved, bias) - value) / step == pytest.approx(by_word[w], abs=1e-5)
    assert (penalty(word, bias + step) - value) / step == pytest.approx(by_bias, abs=1e-5)
    assert toxicity.swap_penalty(word, word, at, of, tuple(x[:0] for x in swaps))[0] == 0


def test_scores_of_language_and_toxicity_against_brute_force(spark):
    """The queries' predictions, text by text from the model's weights alone."""
    source = load(spark)
    learnt = langid.sample(source, queries.fold(3) != 1, key="doc_id", text="text", lang="lang")
    assert learnt == langid.sample(source.repartition(7), queries.fold(3) != 1, key="doc_id", text="text", lang="lang")
    model = langid.fit(*map(list, zip(*learnt)))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(source, queries.fold(3) == 1).collect()}
    for r in source.limit(40).collect():
        words = [w for w in map(langid.letters, langid.words_of(r.text)) if w]
        e, move, start = model.emissions(words)[:, :-1], model.transition, model.start
        a, b = [start + e[0]], [np.zeros(len(model.languages))]
        for t in range(1, len(words)):
            a.append(np.logaddexp.reduce(a[-1][:, None] + move, axis=0) + e[t])
        for t in range(len(words) - 1, 0, -1):
            b.insert(0, np.logaddexp.reduce(move + e[t] + b[0], axis=1))
        p = np.exp(np.array(a) + np.array(b) - np.logaddexp.reduce(a[-1]))
        z = sum(w * np.log(x.mean(0) + 1e-3) for w, x in zip(model.document, (p, p[: langid.ENDS], p[-langid.ENDS :])))
        z = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id] == (model.languages[z.argmax()], pytest.approx(z.max(), abs=1e-9))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.train(source, labels, queries.fold(5) == 0)
    got = {r.doc_id: r.score for r in toxicity.predict(source, labels, queries.fold(5) == 0).collect()}
    for r in source.limit(40).collect():
        sentences, n = [[]], 0
        for w in langid.words_of(r.text):
            if n == toxicity.SENTENCE:
                sentences.append([])
                n = 0
            sentences[-1].append(toxicity.letters(w))
            n += 1
            if toxicity.ends(w):
                sentences.append([])
                n = 0
        worst = max(model.bias + sum(model.rows([w])[0, 0] for w in dict.fromkeys(x) if w) for x in sentences if x)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(model.shift + model.slope * worst))), abs=1e-9)


@pytest.mark.parametrize("predict", ["language", "toxicity"])
def test_odd_tables_of_classifiers(spark, predict):
    """Repeated rows and labels, nulls, a very long text, clashing columns, empty tables."""
    rows = [*ODD, (10, "the quick brown fox " * 20_000, "s"), (11, "a scum and filth. " * 30, "s"), (12, "½ ² ① 123", "s")]
    texts = docs(spark, rows).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    labels = spark.createDataFrame([(11, 1), (11, 0), (11, 1), (5, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    run = (lambda d: langid.predict(d, F.col("doc_id") == 5)) if predict == "language" else (lambda d: toxicity.predict(d, labels, F.col("doc_id") == 5))
    got = run(texts).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({tuple(r) for r in got if r.doc_id == 3}) == 1 and [r.held_out for r in got if r.doc_id is None] == [True]
    if predict == "language":
        assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (8, 9, 10, 11, 12)} == {8: "und", 9: "und", 10: "en", 11: "en", 12: "und"}
    assert run(texts.limit(0)).count() == 0


def test_swapping_identity_terms_changes_little():
    toxic = [f"{g} are scum here." for g in ("muslims", "muslims", "women")] * 4
    clean = [f"{g} live here in peace number {i}." for i, g in enumerate(("christians", "men", "jews", "hindus") * 5)]
    model = toxicity.fit([f"{t} {i}" for i, t in enumerate(toxic)] + clean, [1] * len(toxic) + [0] * len(clean))
    table = model.table()
    neutral = model.texts(table, ["muslims live here.", "christians live here.", "women live here.", "men live here.", "muslims are scum here."])
    assert neutral[4] > 0.5 and abs(neutral[0] - neutral[1]) < 0.25 and abs(neutral[2] - neutral[3]) < 0.25


@pytest.mark.parametrize("joint", ["\u00a0", ".", "/", "_"])
def test_letters_after_the_first_32_count(joint):
    toxic = [f"you are scum and filth, number {i} here" for i in range(12)]
    clean = [f"we live here in peace, number {i} today" for i in range(20)]
    model = toxicity.fit(toxic + clean, [1] * 12 + [0] * 20)
    long = joint.join(["we", "live", "here", "in", "peace", "today"] * 3)
    plain, hidden = model.texts(model.table(), [long, joint.join([long, "you", "are", "scum", "and", "filth"])])
    assert hidden > plain + 0.01  # equal, if only the first letters count
    speech = langid.fit(["we live here in peace"] * 4 + ["wir leben hier in frieden"] * 4, ["en"] * 4 + ["de"] * 4)
    german = joint.join(["we", "live", "here", "in", "peace"] * 2 + ["wir", "leben", "hier", "in", "frieden"] * 20)
    assert speech.texts(speech.table(), [german])[0][0] == "de"


def test_scripts_without_blanks_count_whole():
    toxic = [f"{'和平生活在这里' * 6}你们都是垃圾人渣{i}。" for i in range(12)]
    model = toxicity.fit(toxic + [f"{'和平生活在这里' * 8}{i}。" for i in range(20)], [1] * 12 + [0] * 20)
    assert (model.texts(model.table(), [toxic[3], "和平生活在这里" * 8]) > 0.5).tolist() == [True, False]


def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    own = bpe.WordBPE.from_file(queries.vocabulary(), cache_words=500)
    texts = [r.text for r in load(spark).limit(60).collect()]
    texts += ["", "  ", "ΑΣ ΟΔΟΣ Σ", "İstanbul's I'LL can't", "x<|startoftext|>y <|endoftext|><|endoftext|>", "a\x1cb\x85c d", "½²Ⅷ 123 é é ́x", "日本語 🎉 👩‍👩‍👧", "a" * 3000, "!?" * 2000, "<|STARTOFTEXT|>", "ſ K Å"]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == wanted.ids and own.decode(wanted.ids) == library.decode(wanted.ids, skip_special_tokens=False)
    rows = bpe.encode(docs(spark, ODD), queries.vocabulary(), decoded="back", digests=True)
    assert rows.count() == len(ODD)
    for r in rows.collect():
        wanted = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.ids, r.n_tokens) == (wanted, len(wanted)) and r.ids_sha256 == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
    assert bpe.encode(docs(spark, []), queries.vocabulary()).count() == 0


@pytest.mark.parametrize("around", ["a{}1", "1{}a", "!{}!", "{0}{0}"])
def test_bpe_of_all_code_points(around):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    own = bpe.WordBPE.from_file(queries.vocabulary())
    points = [c for c in (*range(0x33480), *range(0xE0000, 0xE0200), 0xF0000, 0x10FFFF) if not 0xD800 <= c <= 0xDFFF]
    texts = [around.format(chr(c)) for c in points]
    assert not [hex(c) for c, t, w in zip(points, texts, library.encode_batch(texts, add_special_tokens=False)) if own.encode(t) != w.ids]


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "source mixing", "bpe"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "ids", "n_tokens"} <= set(out.columns)
