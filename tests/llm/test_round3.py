"""Infilling, Jaccard join and spelling variants: brute force, round trips and odd cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstream.llm import frames, infilling, jaccard, spelling

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


# --- fill-in-middle -------------------------------------------------------------

TEXTS = ["", " ", "a", " a b  ", "\n\na\x0bb\t\tc", "é ü x 漢字 👍 z", "x" * 700, "ab " * 400, " " * 300, "a <P> b", "<S>", "q<M>"]


@pytest.mark.parametrize("size", [1, 4, 5, 7, 64, 1 << 16])
def test_frames_find_units_and_give_back_the_text(size):
    for text in TEXTS:
        if any(len(c.encode()) > size for c in text):
            continue
        whole, units = text.encode(), UNITS.findall(text)
        made = frames.write([whole[:3], whole[3:]], size)
        read = frames.Text(made)
        assert (made["n"], made["chars"], made["bytes"]) == (len(units), len(text), len(whole))
        assert all(len(read.data(k)) <= size for k in range(len(made["frames"])))
        assert b"".join(read.read()) == whole
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert read.place(k) == (len(head.encode()), len(head)), (text, k)
        for a, b in ((0, 1), (2, 5), (3, len(whole)), (len(whole), len(whole))):
            assert b"".join(read.read(a, b)) == whole[a:b]


def told(i, text, seed=42):
    """The contract in plain Python."""
    u = UNITS.findall(text)
    d = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infilling_by_the_contract(spark):
    rng = random.Random(1)
    rows = [(k, t) for k, t in enumerate(TEXTS * 6)] + [(900 + k, " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))) for k in range(60)]
    rows += [(7777 + k, "wörd " * 40_000 + "end") for k in range(6)]  # several frames
    docs = docs_of(spark, rows + [rows[3], (5000, None)])
    done = infilling.infilled(infilling.framed(docs)).cache()
    out = {r.doc_id: r for r in infilling.texts(done).collect()}
    hashes = {r.doc_id: r for r in infilling.digested(done).collect()}
    assert done.count() == len(rows) + 2
    assert {out[i].form for i, _ in rows} == {"plain", "spm", "psm"}
    for i, text in [*rows, (5000, "")]:
        n, form, p, m, whole = told(i, text)
        assert (out[i].n, out[i].form, out[i].prefix_chars, out[i].middle_chars, out[i].output) == (n, form, p, m, whole)
        assert hashes[i].output_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert hashes[i].restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    done.unpersist()


def test_infilling_of_odd_tables(spark):
    assert infilling.digested(infilling.infilled(infilling.framed(docs_of(spark, [])))).count() == 0
    odd = spark.createDataFrame([(None, "a b c", 1, 2, 3, "r"), (None, None, 1, 2, 3, "r")], "doc_id long, text string, frames int, n int, output int, row string")
    got = infilling.infilled(infilling.framed(odd))
    assert got.columns == ["doc_id", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(r.n for r in got.collect()) == [0, 3]
    only = infilling.framed(odd.select("text"))
    assert only.columns == ["frames"] and only.count() == 2


# --- Jaccard join ----------------------------------------------------------------


def grams_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows):
    sets = [grams_of(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(root(k), []).append(i)
    return Counter((i, len(sets[k]), min(least[root(k)])) for k, (i, _) in enumerate(rows))


def near_texts(seed, n=150):
    """Texts of all lengths with copies of which words are changed, dropped and added, and with a common passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(n):
        kind = rng.random()
        if rows and kind < 0.6:
            w = rng.choice(rows).split(" ")
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                at = rng.randrange(len(w))
                w[at : at + rng.choice((0, 1))] = rng.choices(vocabulary, k=rng.choice((0, 1)))
                w = w or ["x"]
            rows.append(" ".join(w))
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 3, 4, 5, 8, 9, 10, 12, 20, 40, 80, 150, 400))))
            rows.append(f"{text} {passage}" if kind > 0.85 else text)
    return rows


@pytest.mark.parametrize(("seed", "unit"), [(1, jaccard.UNIT), (2, 600), (3, 150)])
def test_jaccard_components_by_brute_force(spark, seed, unit):
    rows = list(enumerate(near_texts(seed), 10))
    rows += [(1, None), (2, ""), (3, " \t"), (4, "One  two"), (5, "one\ntwo"), (6, "a b c d"), (7, "A B C D"), (7, "A B C D")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_sets(docs_of(spark, rows), unit=unit).collect())
    assert got == brute_components(rows)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    scheme = jaccard.Scheme()
    for n in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(200 if n < 100 else 20):
            base = rng.integers(0, 1 << 63, 2 * n + 20, dtype=np.uint64)
            gone = int(rng.integers(0, max(1, n * 15 // 100) + 1))  # as far apart as may be
            more = max(0, (100 * (n - gone) - 85 * n) // 85)
            one, two = np.unique(base[:n]), np.unique(np.concatenate([base[gone:n], base[n : n + more]]))
            common = len(np.intersect1d(one, two))
            if len(two) and 100 * common >= 85 * len(np.union1d(one, two)) and not np.array_equal(one, two):
                assert np.intersect1d(scheme.signatures(one), scheme.signatures(two)).size, (n, gone, more)
    # sets whose shingles crowd into few parts still meet
    crowded = np.arange(1, 41, dtype=np.uint64)
    assert np.intersect1d(scheme.signatures(crowded), scheme.signatures(crowded[1:])).size


def test_tree_finds_what_the_definition_says():
    rng = random.Random(9)
    sets = []
    for _ in range(300):
        base = set(rng.choice(sets)) if sets and rng.random() < 0.7 else set(rng.sample(range(400), rng.randint(1, 60)))
        base = (base - set(rng.sample(sorted(base), min(len(base) - 1, rng.randint(0, 4))))) | set(rng.sample(range(400), rng.randint(0, 3)))
        sets.append(sorted(base))
    arrays = [np.array(s, np.uint32) for s in sets]
    tree = jaccard.PrefixTree(arrays)
    for k in range(0, 300, 7):
        found = {tree.order[p] for p in tree.similar(arrays[k], np.zeros(300, bool)).tolist()}
        assert found == {j for j in range(300) if 100 * len(set(sets[k]) & set(sets[j])) >= 85 * len(set(sets[k]) | set(sets[j]))}


def test_hashes_of_shingles_do_not_depend_on_blocks(monkeypatch):
    text = (" ".join(random.Random(3).choices(WORDS, k=3000)) + " Füße 漢字").encode()
    want = jaccard.shingle_set(text)
    assert len(want) == len(grams_of(text.decode()))
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    assert np.array_equal(jaccard.shingle_set(text), want)


def test_jaccard_of_odd_tables(spark):
    assert jaccard.similar_sets(docs_of(spark, [])).count() == 0
    text = "one two three four five six"
    odd = spark.createDataFrame([(None, text, 1, 2), (None, text, 1, 2), (4, text, 1, 2), (None, "x", 0, 0), (None, None, 0, 0)], "doc_id long, text string, s int, cluster int")
    got = jaccard.similar_sets(odd)
    assert got.columns == ["doc_id", "th", "n_shingles", "component_id"]
    assert sorted((r.n_shingles, r.component_id or -1) for r in got.collect()) == [(0, -1), (1, -1), (3, 4), (3, 4), (3, 4)]


# --- spelling ------------------------------------------------------------------------


def brute_words(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(v):
    near = {w: [x for x in v if one_apart(w, x)] for w in v}
    form = {w: min(near[w], key=lambda x: (-v[x], x)) for w in v if near[w]}
    form = {w: f for w, f in form.items() if v[f] >= 10 * v[w]}
    out = {}
    for w in v:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, v[w], len(near[w]), v[form[w]] if w in form else None)
    return out


def variants_of(vocabulary, **more):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(vocabulary, **more).collect()}


@pytest.mark.parametrize("unit", [spelling.UNIT, 3])
def test_variants_by_brute_force(spark, unit):
    rng = random.Random(4)
    words = {"aaaaaaa", "aaaaaaaa", "aaaaaaab", "baaaaaaa", "ÿaaaaaaa", "abababab", "babababa", "ababababa"}
    while len(words) < 700:
        w = list(rng.choice(sorted(words))) if rng.random() < 0.7 else rng.choices("abcé", k=rng.randint(7, 12))
        at = rng.randrange(len(w))
        w[at : at + rng.choice((0, 1))] = rng.choices("abcéö", k=rng.choice((0, 1, 1)))
        if 7 <= len(w) <= 40:
            words.add("".join(w))
    v = {w: rng.choice((2, 2, 3, 20, 25, 300, 3000)) for w in sorted(words)}
    table = spark.createDataFrame(sorted(v.items()), "word string, n long")
    assert variants_of(table, unit=unit) == brute_variants(v)


def test_spelling_by_the_contract(spark):
    rng = random.Random(8)
    stems = ["reconnoitre", "Sprachgefühl", "ENCYCLOPEDIA", "Éclairage", "straßenbahn", "chrysanthemum"]
    rows = []
    for k in range(400):
        w = rng.choices(stems, weights=(200, 40, 9, 5, 3, 1), k=30)
        rows.append((k, "".join(x + rng.choice((" ", ", ", "-", "7", "漢", "\n")) for x in w)))
    rows += [(1, None), (2, ""), (3, rows[0][1]), rows[5], (9, "chrysanthemum" * 3000)]
    v = brute_words(rows)
    counted = spelling.word_counts(docs_of(spark, rows))
    assert {r.word: r.n for r in counted.collect()} == v
    got = variants_of(counted)
    assert got == brute_variants(v) and any(x[0] for x in got.values())


def test_chains_of_forms_end_at_the_root(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    table = spark.createDataFrame([(w, 2 * 10**k) for k, w in enumerate(chain)] + [("zzzzzzz", 5)], "word string, n long")
    got = variants_of(table)
    assert [got[w][:2] for w in chain] == [*[(chain[k + 1], chain[-1]) for k in range(5)], (None, chain[-1])]
    assert got["zzzzzzz"] == (None, "zzzzzzz", 5, 0, None)


def test_spelling_of_odd_tables(spark):
    assert spelling.variants(spelling.word_counts(docs_of(spark, []))).count() == 0
    odd = spark.createDataFrame([(None, "Wörterbuch wörterbuch", 1, 2)] * 2, "doc_id long, text string, word int, n int")
    assert sum(r.n for r in spelling.word_counts(odd).collect()) == 4


def test_equal_places_in_every_task(spark):
    docs = docs_of(spark, [(k, f"wordone{k % 7} wordtwoo") for k in range(300)])
    one = {r.word: r.n for r in spelling.word_counts(docs.coalesce(1)).collect()}
    assert one == {r.word: r.n for r in spelling.word_counts(docs.repartition(7, F.col("doc_id"))).collect()}


def test_rows_are_filtered_before_they_are_dealt(spark):
    rows = spark.range(-3000, 3000).select((F.col("id") * 7_919_191_919).alias("k"))
    wanted = rows.where(F.pmod(F.xxhash64("k"), F.lit(10)) == 0)
    kept = jaccard._maybe_in(rows, wanted, "k")
    assert wanted.subtract(kept).isEmpty() and wanted.count() <= kept.count() < 1.05 * wanted.count()
    assert jaccard._maybe_in(rows, wanted.limit(0), "k").isEmpty()


# --- columns of the user's own -----------------------------------------------------


def underscored():
    """Every name with an underscore that the operators' code writes."""
    from pathlib import Path

    found = set()
    for path in Path(jaccard.__file__).parent.glob("*.py"):
        found |= set(re.findall(r"""["'](_[a-z_]+)["']""", path.read_text()))
    return sorted(found)


def test_no_column_of_the_user_clashes_or_is_lost(spark):
    from gridstream.llm import fm_index, html_lines, importance, langid, line_dedup, media, sentence_spans, simhash

    names = underscored()
    assert {"_id", "_th", "_drop", "_edges", "_lines", "_s", "_n", "_p", "_label_id"} <= set(names)
    line = "a common line of many characters"
    rows = [(k, f"{line}\nown words {k} alpha beta gamma delta") for k in range(6)]
    docs = docs_of(spark, rows).select("doc_id", "text", *[F.concat(F.lit(f"{n}/"), F.col("doc_id").cast("string")).alias(n) for n in names])
    bench = spark.createDataFrame([("i", "own words 3 alpha beta gamma delta")], "item_id string, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int")
    model = langid.learn(docs.withColumn("lang", F.lit("en")), F.lit(True), sample=20)
    stored = media.with_tensors(media.encode_media(docs))
    found = {
        "lines": line_dedup.dedup_lines(docs), "spans": fm_index.find_contamination(docs, bench), "cut": fm_index.without_spans(fm_index.find_contamination(docs, bench)),
        "language": langid.identify(docs, model), "near": simhash.first_of_groups(docs), "chosen": importance.sample_documents(docs, labels),
        "media": media.media_digest(media.encode_media(docs)), "tensors": media.stored_digest(stored), "sentences": sentence_spans.dedup_spans(docs),
        "html": html_lines.extract_main_text(docs.withColumnRenamed("text", "html")), "fim": infilling.infilled(infilling.framed(docs)),
    }
    for name, df in found.items():
        out = df.collect()
        assert out, name
        for r in out if name != "chosen" else []:  # that one returns its own columns alone
            assert all(r[n] == f"{n}/{r.doc_id}" for n in names), name
    assert {r.n_dropped for r in found["lines"].collect()} == {0, 1}
    renamed = line_dedup.dedup_lines(docs.drop("_id").withColumnRenamed("doc_id", "_id"), doc_id="_id")
    assert sorted((r._id, r.n_dropped) for r in renamed.collect()) == [(k, int(k < 5)) for k in range(6)]


def test_a_language_of_one_much_repeated_text_is_learned(spark):
    from gridstream.llm import langid

    rng = random.Random(6)
    english = [("en", " ".join(rng.choices(WORDS, k=30))) for _ in range(400)]
    for trial in range(4):
        german = [("de", f"das ist ein deutscher Satz über Äpfel und Birnen Nummer {trial}")] * 3000
        docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(english + german)], "doc_id long, text string, lang string")
        model = langid.learn(docs, F.lit(True), sample=60)
        assert model[0] == ["de", "en"]
        got = langid.identify(docs.where("doc_id IN (1, 500)"), model).collect()
        assert {r.lang: r.lang_pred for r in got} == {"en": "en", "de": "de"}
