"""Operators on small tables: brute force, round trips, and the odd cases (nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns)."""

from __future__ import annotations

import hashlib
import pickle
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gridstream.llm import common, components, fm_index, html_lines, importance, langid, line_dedup, media, packing, queries, sentence_spans, simhash, tokens, training_order
from gridstream.llm.queries import tokenizer_path

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def docs_of(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def empty(spark):
    return docs_of(spark, [])


# --- HTML ---------------------------------------------------------------------


def test_main_text_of_a_named_article():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><nav><a>Home</a></nav><div class="ad-box">Buy</div>
<article><header><h1>A &amp; B</h1></header><p>One <b>bold</b>  two<br>three<p>x<aside>side</aside><form>f</form><ul><li>i</li><li>j</li></ul><!-- c --></article>
<section id="comments"><p>nice</p></section><footer>&copy;</footer></body></html>"""
    assert html_lines.main_text(page) == "A & B\nOne bold two three\nx\ni\nj"


def test_main_text_by_line_blocks_alone():
    long, menu = "word " * 40, "".join(f"<div><a href=/{k}>link number {k} of the menu</a></div>" for k in range(9))
    page = f"<body class=has-sidebar>{menu}<div class=with-header><h1>Title</h1><section><p>{long}</p></section><div class=ad>buy</div><div><p>short</p></div><p>{long}</div>{menu}<div>tail</div></body>"
    assert html_lines.main_text(page).split("\n") == ["Title", long.strip(), "short", long.strip()]


def test_comments_are_no_article():
    page = "<main><p>Text.</p></main><article class='comment'><p>Nice!</p></article><div class='reader-comments'><article><p>Yes</p></article></div>"
    assert html_lines.main_text(page) == "Text."


def test_a_teaser_card_is_no_article():
    text = "word " * 60
    for card in ("<article></article>", "<article><h3>Read this too</h3></article>"):
        got = html_lines.main_text(f"<body><div><h1>Title</h1><p>{text}</p><p>{text}</p></div><div class=ad>buy</div><nav>x</nav><aside>y</aside>{card}</body>")
        assert got.split("\n")[:3] == ["Title", text.strip(), text.strip()]


def test_windows_decide_inside_a_named_article():
    text = "word " * 60
    links = "".join(f"<li><a href=/{k}>see also number {k}</a></li>" for k in range(5))
    page = f"<article><p>Share</p><nav>a</nav><nav>b</nav><nav>c</nav><h1><a href=/>Title</a></h1><p>{text}</p><p>short</p><ul>{links}</ul><p>Print</p></article><p>{text * 2}</p>"
    assert html_lines.main_text(page).split("\n") == ["Title", text.strip(), "short", (text * 2).strip()]
    assert html_lines.main_text("<article><h1>Title</h1><p>Text.</p></article><p>Imprint</p>") == "Title\nText."


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<!-- x", "<script>a", "</div></p>", "<article></article>"])
def test_odd_pages(page):
    assert html_lines.main_text(page) == ("<p" if page == "<p" else "")


def test_surges_end_at_blank_windows():
    assert html_lines.surges([0, 5, 0, 0, 5, 0, 0, 0, 5], 0) == [(1, 5), (8, 9)]


BODY = "word " * 60


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post category-social">%s</article>', '<article class="overflow-hidden">%s</article>', '<article><div class="share-price">%s</div></article>',
        '<article><section class="related-work">%s</section></article>', "<article><div data-x='a<b>c' title=\"a hidden gem\">%s</div></article>", "<article><div id=tag-social-media>%s</div></article>",
    ],
)
def test_attributes_that_only_sound_like_boilerplate(page):
    assert html_lines.main_text(page % f"<p title='a hidden gem'>{BODY}</p>") == BODY.strip()


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; display : none'", "class='x ad-box'", "class=site-footer", "id='related-posts'", "role=navigation", "class='cookie_banner_2'"])
def test_attributes_that_name_boilerplate(attrs):
    assert html_lines.main_text(f"<main><p>{BODY}</p><div {attrs}><p>{BODY}</p></div></main>") == BODY.strip()


@pytest.mark.parametrize("name", ["teaser", "byline", "tags", "entry-header"])
def test_an_article_has_its_own_parts(name):
    page = f"<article><h1>Title</h1><p class={name}>Own part.</p><p>{BODY}</p></article><p class={name.split('-')[-1]}>Not mine.</p>"
    assert html_lines.main_text(page).split("\n") == ["Title", "Own part.", BODY.strip()]
    assert html_lines.main_text(f"<body><div class=content-header><h1>Title</h1></div><p>{BODY}</p></body>").split("\n") == ["Title", BODY.strip()]


def test_a_form_around_the_page_is_no_form():
    search, sign = "<form><p>Search the site</p><input></form>", "<div><form><label>Your name</label><button>Send</button></form></div>"
    page = f"<body><form method=post><nav>menu</nav><h1>Title</h1><p>{BODY}</p><button>Save</button></form>{search}{sign}</body>"
    assert html_lines.main_text(page).split("\n") == ["Title", BODY.strip()]
    inside = f"<form><article><p>{BODY}</p></article></form>{search}"
    assert html_lines.main_text(inside) == BODY.strip()
    assert html_lines.main_text(f"<p>{BODY}</p>{search}{sign}<form>open") == BODY.strip()


def test_short_blocks_before_a_long_one_stay():
    menu = "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(6))
    shorts = [f"Short {k}." for k in range(12)]
    page = f"<body><ul>{menu}</ul>{''.join(f'<p>{s}</p>' for s in shorts)}<p>{BODY}</p></body>"
    assert html_lines.main_text(page).split("\n") == [*shorts, BODY.strip()]
    assert html_lines.main_text(f"<p>Hi.</p><p>x</p><p>{BODY}</p>").split("\n") == ["Hi.", "x", BODY.strip()]


def test_linked_references_are_text_of_the_article():
    cited = [f"An Author, the title of a long work in so many words, number {k}" for k in range(5)]
    page = f"<article><p>{BODY}</p><ul>{''.join(f'<li><a href=/>{c}</a></li>' for c in cited)}</ul></article>"
    assert html_lines.main_text(page).split("\n") == [BODY.strip(), *cited]


def test_copyright_lines_and_comments_without_a_class():
    for line in ("&copy; 2024 Example Press. All rights reserved.", "Copyright 2024 Example", "(c) Example", "Copyright &copy; Example"):
        assert html_lines.main_text(f"<body><p>{BODY}</p><div>{line}</div></body>") == BODY.strip()
    kept = "Copyright law changed in the year of the reform."
    assert html_lines.main_text(f"<body><p>{BODY}</p><p>{kept}</p></body>").split("\n") == [BODY.strip(), kept]
    assert html_lines.main_text(f"<article><p>{BODY}</p></article><h3>12 Comments</h3><div><p>{BODY * 3}</p></div>") == BODY.strip()


@pytest.mark.parametrize(
    "page",
    ["<form>a" * 120_000, "<a " * 350_000, "<a" * 500_000, "<!" * 500_000, "<a =\"" * 200_000, "<a ='\"" * 200_000, "<div>" * 100_000 + "</b></span>" * 50_000, "<span><article>" + "<div>" * 80_000 + "</span>" * 80_000,
     "<script>" * 120_000, "<script " * 120_000, "<!--" * 250_000, "<p>a" * 200_000, "&amp" * 250_000],
    ids=range(13),
)
def test_a_megabyte_of_broken_markup_takes_linear_time(page):
    began = time.perf_counter()
    html_lines.main_text(page)
    assert time.perf_counter() - began < 4


def test_extract_keeps_rows_and_replaces_columns(spark):
    df = spark.createDataFrame([(1, None, "old", 7), (1, None, "old", 7), (2, "<p>é", "old", 7)], "page_id long, html string, text string, n_chars int")
    out = html_lines.extract_main_text(df)
    assert sorted(map(tuple, out.collect())) == [(1, "", 0), (1, "", 0), (2, "é", 1)] and out.columns == ["page_id", "text", "n_chars"]
    assert html_lines.extract_main_text(df.limit(0)).count() == 0


# --- media --------------------------------------------------------------------


@pytest.mark.parametrize("text", [None, "", "a", "é" * 96, "x" * 193, "long " * 50_000])
def test_media_round_trip(text):
    payload = media.payload_of(text)
    raw = (text or "").encode()
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(raw) and not payload[len(raw) :].strip(b" ")
    assert media.from_wave(media.to_wave(payload)) == payload


def test_polyphase_equals_direct_resampling():
    x = np.random.default_rng(0).standard_normal(192).astype(np.float32)
    got = media.resample(x)
    n = media.TAPS * media.UP
    h = np.sinc((np.arange(n) - (n - 1) / 2) / 3) / 3 * np.hamming(n) * media.UP
    up = np.zeros(media.UP * len(x))
    up[:: media.UP] = x
    padded = np.concatenate([np.zeros(n), up, np.zeros(n)])
    shift = media.UP * (media.TAPS - 1 - media.TAPS // 2)
    want = [sum(h[k] * padded[n + m * media.DOWN + shift - k] for k in range(n)) for m in range(len(got))]
    assert len(got) == 128
    best = max(np.corrcoef(got[5:-5], np.roll(want, s)[5:-5])[0, 1] for s in range(-3, 4))
    assert best > 0.98


def test_hysteresis():
    power = np.array([0, 0, 10, 4, 10, 0, 0, 0, 4.0])
    assert media.segments(power, 0.5, 0.25) == [(2, 5)]


def test_media_queries(spark):
    df = docs_of(spark, [(1, "same"), (2, "same"), (3, None), (4, "")])
    out = {r.doc_id: r for r in media.media_digest(media.encode_media(df)).collect()}
    assert out[1][2:] == out[2][2:] and out[3][2:] == out[4][2:]
    assert out[1].payload_sha256 == hashlib.sha256(b"same" + b" " * 188).hexdigest() and out[1].tail_crc32 == zlib.crc32(b" " * 16)
    blocks = media.media_tensors(media.encode_media(docs_of(spark, [(5, "tone " * 2000), (6, None)]))).orderBy("key", "block").toArrow()
    tensor = media.tensor_column(blocks["mel"])
    assert tensor.type == pa.fixed_shape_tensor(pa.float16(), (media.BLOCK, media.MELS)) and set(blocks["key"].to_pylist()) == {5, 6}
    assert tensor.to_numpy_ndarray().shape[1:] == (media.BLOCK, media.MELS)
    assert media.media_digest(media.encode_media(empty(spark))).count() == 0


def test_the_media_query_stores_waves_and_tensors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    got = queries.op2_media(spark, "/root/testdata/sf0.001")
    stored = {name: spark.read.parquet(f"file://{next(tmp_path.glob(name + '-*'))}") for name in ("waves", "tensors")}
    assert stored["waves"].where("media IS NULL").count() == 0 and stored["tensors"].where("tensors.mel IS NULL").count() == 0
    cell = stored["tensors"].select("tensors.mel", F.size("tensors.spans").alias("n")).first()
    with pa.ipc.open_stream(cell.mel) as stream:
        assert stream.schema.field("mel").type == pa.fixed_shape_tensor(pa.float16(), (media.BLOCK, media.MELS)) and len(stream.read_all()) == cell.n
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    want = media.media_digest(media.encode_media(docs).drop("text"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    none = spark.createDataFrame([(1, None), (2, media.to_wave(media.payload_of("tone " * 3000)))], "doc_id long, media binary")
    assert sorted(map(str, media.stored_digest(media.with_tensors(none)).collect())) == sorted(map(str, media.media_digest(none).collect()))


def test_media_with_clashing_columns(spark):
    df = docs_of(spark, [(1, "tone " * 300), (1, "tone " * 300), (2, None)]).withColumn("feature", F.lit(1)).withColumn("tensors", F.lit("x")).withColumn("media", F.lit(0))
    waves = media.encode_media(df).drop("text")
    one, two = media.media_digest(waves.drop("tensors")), media.stored_digest(media.with_tensors(waves))
    assert one.columns == two.columns and one.columns.count("feature") == 1 and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_log_mel_against_plain_sums():
    rng = np.random.default_rng(22)
    x = rng.standard_normal(64 * 5).astype(np.float32)
    mel, power = media.log_mel(x)
    rate = media.RATE * media.UP / media.DOWN
    to_mel, to_hertz = (lambda f: 2595 * np.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = [to_hertz(to_mel(40) + k * (to_mel(rate / 2) - to_mel(40)) / 17) for k in range(18)]
    padded = [*x.tolist(), *[0.0] * 64]
    for t in range(5):
        own = padded[64 * t : 64 * t + 128]
        frame = [v * 0.5 * (1 - np.cos(2 * np.pi * k / 128)) for k, v in enumerate(own)]
        for m in range(16):
            total = 0.0
            for f in range(65):
                hertz = f * rate / 128
                weight = max(0.0, min((hertz - edges[m]) / (edges[m + 1] - edges[m]), (edges[m + 2] - hertz) / (edges[m + 2] - edges[m + 1])))
                if weight:
                    total += weight * abs(sum(v * np.exp(-2j * np.pi * f * k / 128) for k, v in enumerate(frame))) ** 2
            assert abs(mel[t, m] - np.log(total + 1e-6)) < 2e-2
        assert abs(power[t] - 10 * np.log10(np.mean(np.square(frame)) + 1e-9)) < 1e-2


def test_resampling_of_a_tone_and_in_chunks(monkeypatch):
    t = np.arange(9000)
    got = media.resample(np.sin(2 * np.pi * 500 * t / 8000).astype(np.float32))
    want = np.sin(2 * np.pi * 500 * (np.arange(6000) * 1.5) / 8000)
    lag = min(range(-6, 7), key=lambda s: np.abs(np.roll(got, s)[50:-50] - want[50:-50]).max())
    near = min(np.abs(np.roll(got, lag)[50:-50] - np.sin(2 * np.pi * 500 * (np.arange(6000) * 1.5 + d) / 8000)[50:-50]).max() for d in np.linspace(-1.5, 1.5, 61))
    assert near < 0.03
    raw = np.random.default_rng(1).integers(0, 256, 192 * 40).astype(np.uint8)
    whole = media.resample((raw.astype(np.float32) - 128) / 128)
    monkeypatch.setattr(media, "CHUNK", 64)
    assert np.abs(media.resample(raw) - whole).max() < 1e-5


# --- tokens, packing, order ----------------------------------------------------


def test_encoder_equals_the_tokenizer(spark):
    e = tokens.encoder(tokenizer_path())
    rng = random.Random(1)
    texts = ["", " ", "Hello's DON'T", "naïve café", "a\x85b\xa0c", "x\x1cy", "ΣΑΣ İ", "<|endoftext|> x", "1 22,3!!", "日本", "é" * 50]
    texts += ["".join(rng.choice("aB '.,!9é\nß?-") for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def one_at_a_time(lengths, capacity):
    """Sequences of best fit, longest first."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        gaps.remove(min(fit)) if fit else None
        gaps.append((min(fit) if fit else capacity) - x)
    return len(gaps)


def test_packing(spark):
    rng = random.Random(2)
    rows = [(k if k % 9 else None, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 60, 300])))) for k in range(200)] + [(1000, None), (1001, ""), (1001, "")]
    pieces = packing.token_pieces(docs_of(spark, rows).repartition(5), tokenizer_path(), capacity=100)
    got = packing.pack(pieces, 100).collect()
    n = check_packing(got, 100)
    total = sum(r.length for r in got)
    assert n <= one_at_a_time([r.length for r in got], 100) + 1
    want = sum(len(tokens.encoder(tokenizer_path()).encode(t or "")) // 4 + 1 for _, t in rows)
    assert total == want and sum(r.doc_id == 1001 for r in got) == 2
    assert packing.pack(packing.token_pieces(empty(spark), tokenizer_path())).count() == 0


def test_sweep_is_best_fit():
    rng = random.Random(3)
    for _ in range(30):
        capacity = rng.randrange(5, 40)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 120))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        placed, fill = 0, {}
        for length, _, n, first, offset in packing.sweep(counts, capacity):
            placed += n
            for s in range(first, first + n):
                assert fill.get(s, 0) == offset
                fill[s] = offset + length
        assert placed == len(lengths) and max(fill.values(), default=0) <= capacity
        assert len(fill) <= one_at_a_time(lengths, capacity) + 1


def test_the_plan_does_not_grow_with_the_pieces():
    rng = random.Random(23)
    shape = {x: rng.random() ** 4 for x in range(1, 2049)}
    sizes = []
    for n in (10**3, 10**6, 10**9, 10**12):
        counts = {x: max(1, int(w * n)) for x, w in shape.items()}
        plan = packing.sweep(counts)
        placed, last = sum(x[2] for x in plan), max(x[3] + x[2] for x in plan)
        assert placed == sum(counts.values()) and last <= 1.01 * (sum(x * c for x, c in counts.items()) / 2048 + 2048)
        sizes.append(len(plan))
    assert max(sizes) < 3 * 2048 * 10 and sizes[-1] < 2 * sizes[1]


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_permutation(n):
    x = np.arange(n)
    y = training_order.permute(x, n, 9)
    assert sorted(y) == x.tolist() and (training_order.permute(y, n, 9, back=True) == x).all()
    assert n < 64 or (y != training_order.permute(x, n, 10)).any()


def test_shards_are_resumable(spark, tmp_path):
    rows = [(k, " ".join(WORDS * (k % 7))) for k in range(60)] + [(None, None), (3, "")]
    found = training_order.sequences(docs_of(spark, rows).repartition(3), tokenizer_path(), length=16)
    slotted = training_order.with_slots(found, 4).cache()
    path = f"file://{tmp_path}/shards"
    got = training_order.shards(slotted, 16, 10, path).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(len(got))) and all(r.position == r.slot % 10 for r in got)
    ids = {r.slot: r.ids for r in slotted.collect()}
    for start in (0, 7, 23):
        for k, record in enumerate(training_order.read_from(path, start, 15, 16, 10)):
            raw = record.astype("<u2").tobytes()
            assert raw.startswith(ids[start + k]) and zlib.crc32(raw) == got[start + k].crc32
    assert training_order.shards(training_order.with_slots(training_order.sequences(empty(spark), tokenizer_path()), 1)).count() == 0


# --- lines and sentences ---------------------------------------------------------


def test_sequences_hold_every_text(spark):
    rng = random.Random(21)
    rows = [(k if k % 5 else None, rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 9, 40, 400])))])) for k in range(80)] + [(7, "again"), (7, "again")]
    df = docs_of(spark, rows).withColumn("ids", F.lit(1)).withColumn("slot", F.lit("x")).coalesce(1)
    got = training_order.sequences(df, tokenizer_path(), length=16).collect()
    e = tokens.encoder(tokenizer_path())
    want, owner, inside = [], [], []
    for i, t in rows:
        own = [*np.frombuffer(e.encode(t or ""), "<u4").tolist(), training_order.END]
        want += own
        owner += [i] * len(own)
        inside += range(len(own))
    have = [np.frombuffer(r.ids, "<u2").tolist() for r in got]
    assert sum(have, []) == want and {len(x) for x in have[:-1]} == {16}
    for k, r in enumerate(got):
        part = [(o, j) for o, j in zip(owner[16 * k : 16 * k + 16], inside[16 * k : 16 * k + 16], strict=True)]
        assert r.doc_ids == [o for n, (o, j) in enumerate(part) if n == 0 or j == 0] and r.start == part[0][1] and r.n_tokens == len(part)
    assert training_order.sequences(empty(spark), tokenizer_path()).count() == 0
    slotted = training_order.with_slots(training_order.sequences(df, tokenizer_path(), length=16), 3)
    assert sorted(r.slot for r in slotted.collect()) == list(range(len(got)))


def test_a_short_record_is_told_from_text(spark, tmp_path):
    path = f"file://{tmp_path}/shards"
    slotted = training_order.with_slots(training_order.sequences(docs_of(spark, [(1, "one two three")]), tokenizer_path(), length=16), 1)
    (row,) = training_order.shards(slotted, 16, 10, path).collect()
    (record,) = training_order.read_from(path, 0, 5, 16, 10)
    assert (record != training_order.PAD).sum() == row.n_tokens and record[row.n_tokens - 1] == training_order.END


def test_the_query_writes_its_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_dir", lambda _: f"file://{tmp_path}")
    out = queries.op3_training_order(spark, "/root/testdata/sf0.001").orderBy("slot").collect()
    (folder,) = tmp_path.glob("shards-*")
    records = list(training_order.read_from(f"file://{folder}", 0, len(out)))
    assert len(records) == len(out) and [zlib.crc32(x.tobytes()) for x in records] == [r.crc32 for r in out]
    assert all(r.slot == r.shard * training_order.SHARD + r.position for r in out)


def brute_lines(rows, min_chars, min_docs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\t\n\x0b\f\r"))

    held = {}
    for i, t in rows:
        for x in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(x, set()).update({i} - {None})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and i != max(held[key(x)]) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    pool = ["Some Line %d" % k for k in range(6)] + [" some line 1\t", "", "x", "É line", "é line", "A" * 30, "a" * 30 + "\x0b"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9)))) for k in range(40)] + [(100, None), (101, ""), (5, "Some Line 1\nown"), (7, "dup\nSome Line 2"), (7, "dup\nSome Line 2"), (None, "Some Line 3\nx")]
    df = docs_of(spark, rows).withColumn("kept", F.lit("old"))
    got = line_dedup.dedup_lines(df, 4, 3).select("doc_id", "kept", "n_lines", "n_dropped").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_lines(rows, 4, 3)))
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    one = "\n".join(f"line number {k} of a long text" for k in range(30_000))
    long = line_dedup.dedup_lines(docs_of(spark, [(1, one), (2, one), (3, one + "\nend")])).orderBy("doc_id").collect()
    assert [(r.n_dropped, len(r.kept)) for r in long] == [(30_000, 0), (30_000, 0), (0, len(one) + 4)]


def test_line_dedup_counts_documents_not_rows(spark):
    shared = "one and the same line of text"
    rows = [(5, shared), (5, f"{shared}\nother"), (9, shared)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()} == {0}
    got = line_dedup.dedup_lines(docs_of(spark, [*rows, (2, shared)])).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(2, 1), (5, 1), (5, 1), (9, 0)]


def test_sentences_tile_the_text():
    for t in ["", "a", "One. Two!  Three?\n\nFour", "\n\n", " . . ", "No end"]:
        spans = sentence_spans.sentences_of(t)
        assert "".join(t[a:b] for a, b in spans) == t


def test_sentence_spans(spark):
    p = "The first sentence of the passage is here. The second one follows it at once. And the third one ends this part of it."
    rows = [(1, f"Own start here. {p} Own end."), (2, f"Other words. {p.upper()}"), (3, "Clean text. With two sentences."), (4, None), (5, ""), (6, f"{p} Middle. {p}"), (6, f"{p} Middle. {p}")]
    got = {r.doc_id: r for r in sentence_spans.dedup_spans(docs_of(spark, rows), 2, 10).collect()}
    assert got[1].kept == rows[0][1] and got[1].n_removed == 0
    assert got[2].kept == "Other words. " and got[2].n_removed == 3
    assert got[6].kept == "Middle. " and got[3].n_removed == 0 and got[4].kept is None and got[5].kept == ""
    assert sentence_spans.dedup_spans(empty(spark)).count() == 0


def test_sentence_spans_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))) + "." for _ in range(7)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 8)))) for k in range(40)]
    first, want = {}, {}
    runs = {k: sentence_spans.runs_of(t, 2, 4) for k, t in rows}
    for k, (_, a, _, h) in sorted(runs.items(), key=lambda x: (x[0], xxhash.xxh64(rows[x[0]][1], seed=42).intdigest())):
        for i, x in zip(a, h, strict=True):
            first.setdefault(x, (k, i))
    for k, (_, a, b, h) in runs.items():
        want[k] = len({s for i, j, x in zip(a, b, h, strict=True) if first[x] != (k, i) for s in range(i, j + 1)})
    assert {r.doc_id: r.n_removed for r in sentence_spans.dedup_spans(docs_of(spark, rows), 2, 4).collect()} == want


@pytest.mark.parametrize("shift", range(10))
def test_long_passages_are_found_at_every_offset(spark, shift):
    rng = random.Random(shift)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    own = [[word() for _ in range(23)], [word() for _ in range(23 + shift)]]
    rows = [(k, " ".join([*x, *passage, *[word() for _ in range(30)]])) for k, x in enumerate(own)]
    got = {r.doc_id: r.kept.split() for r in sentence_spans.dedup_spans(docs_of(spark, rows)).collect()}
    assert got[0] == rows[0][1].split()
    gone = [w for w in rows[1][1].split() if w not in got[1]]
    assert len(gone) >= 60 - 2 * sentence_spans.LONGEST and set(gone) <= set(passage)


def test_sentence_spans_of_text_without_spaces(spark):
    rng = random.Random(3)
    line = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    passage = f"{line(15)}\u3002{line(12)}\uff01{line(14)}\uff1f"
    rows = [(1, f"{line(9)}\u3002{passage}{line(8)}\u3002"), (2, f"{line(30)}\u3002{passage}{line(21)}\u3002")]
    got = {r.doc_id: r for r in sentence_spans.dedup_spans(docs_of(spark, rows)).collect()}
    assert got[1].kept == rows[0][1] and got[2].kept == rows[1][1].replace(passage, "")
    assert sentence_spans.sentences_of("\u3042\u3002\u3044\uff01") == [(0, 2), (2, 4)]


def test_last_sentence_of_a_passage_goes_too(spark):
    own = lambda c, n: " ".join(f"{c}{k}" for k in range(n)) + "."
    passage = " ".join(own(c, n) for c, n in (("p", 10), ("q", 9), ("r", 10), ("s", 8)))
    rows = [(1, f"{own('a', 9)} {passage} {own('b', 9)}"), (2, f"{own('c', 9)} {passage} {own('d', 9)}")]
    got = {r.doc_id: r.kept for r in sentence_spans.dedup_spans(docs_of(spark, rows)).collect()}
    assert got[2] == f"{own('c', 9)} {own('d', 9)}"


def brute_spans(rows, min_sentences, min_words):
    """Sentences removed from texts whose sentences end at ". " and have at most ten words; own splitting, own runs."""
    def runs(text):
        own = [x.lower().split() for x in re.findall(r"[^.]+\.\s*", text)]
        n, found = len(own), set()
        size = lambda a, b: sum(map(len, own[a : b + 1]))
        for i in range(n):
            ahead = [j for j in range(i, n) if j - i + 1 >= min_sentences and size(i, j) >= min_words]
            back = [j for j in range(i + 1) if i - j + 1 >= min_sentences and size(j, i) >= min_words]
            found |= {(i, min(ahead))} if ahead else set()
            found |= {(max(back), i)} if back else set()
        return own, found or ({(0, n - 1)} if n else set())

    first, texts = {}, {}
    for place, (i, t) in enumerate(rows):
        texts[place] = runs(t)
        own, found = texts[place]
        for a, b in found:
            key = str(own[a : b + 1])
            at = (i is not None, i or 0, a)
            first[key] = min(first.get(key, at), at)
    out = []
    for place, (i, _) in enumerate(rows):
        own, found = texts[place]
        gone = {k for a, b in found if first[str(own[a : b + 1])] != (i is not None, i or 0, a) for k in range(a, b + 1)}
        out.append((i, len(own), len(gone), ". ".join(" ".join(w).rstrip(".") for k, w in enumerate(own) if k not in gone)))
    return out


@pytest.mark.parametrize("held", [1 << 20, 9])
def test_sentence_spans_against_own_splitting(spark, monkeypatch, held):
    monkeypatch.setattr(sentence_spans, "HELD", held)
    rng = random.Random(15)
    pool = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))).capitalize() + "." for _ in range(9)]
    rows = [(k if k else None, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 12)))) for k in range(60)]
    df = docs_of(spark, rows).repartition(3)
    got = [(r.doc_id, r.n_sentences, r.n_removed, " ".join(r.kept.lower().split()).rstrip(".")) for r in sentence_spans.dedup_spans(df, 3, 6).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_spans(rows, 3, 6)))


def test_sentence_spans_of_odd_rows(spark):
    short = "same short text."
    rows = [("b", short, 1), ("a", short, 2), ("c", "Der Satz eins. Kurz.", 3), ("d", " der satz  eins. kurz.", 4), (None, short, 5), ("e", " \n ", 6), ("f", "", 7), ("g", None, 8), ("b", "another text", 9), ("b", short, 10)]
    df = spark.createDataFrame(rows, "doc_id string, text string, _n int").withColumn("kept", F.lit("old")).withColumn("extra", F.lit(1))
    out = sentence_spans.dedup_spans(df)
    assert out.columns == ["doc_id", "text", "_n", "extra", "kept", "n_sentences", "n_removed"]  # a name with an underscore is the user's
    got = sorted((repr(r.doc_id), r.text, r.kept, r.n_sentences, r.n_removed) for r in out.select("doc_id", "text", "kept", "n_sentences", "n_removed").collect() if r.text)
    assert got == sorted([("None", short, short, 1, 0), ("'a'", short, "", 1, 1), ("'b'", short, "", 1, 1), ("'b'", short, "", 1, 1), ("'b'", "another text", "another text", 1, 0), ("'c'", rows[2][1], rows[2][1], 2, 0), ("'d'", rows[3][1], "", 2, 2), ("'e'", " \n ", " \n ", 1, 0)])
    assert sorted(repr((r.kept, r.n_sentences)) for r in out.collect() if not r.text) == ["('', 0)", "(None, 0)"]


def test_sentence_spans_of_a_long_text(spark):
    rng = random.Random(16)
    tale = " ".join(f"w{rng.randrange(10**6)}é" + ("." if k % 7 == 0 else "") for k in range(200_000))
    got = {r.doc_id: r for r in sentence_spans.dedup_spans(docs_of(spark, [(1, tale), (2, f"Own start here. {tale}"), (3, "Clean.")])).collect()}
    assert got[1].kept == tale and got[1].n_removed == 0 and len(got[2].kept) < 100 and got[3].kept == "Clean."


def test_a_passage_in_very_many_documents(spark):
    p = " ".join(f"{w} {v} {w}{v}." for w in WORDS for v in WORDS[:3])
    rows = [(k, f"Own{k} a{k} b{k}. {p} End{k} c{k}.") for k in range(3000)]
    out = sentence_spans.dedup_spans(docs_of(spark, rows).repartition(7), min_words=40)
    assert {(r.doc_id == 0, r.kept) for r in out.where("doc_id % 500 = 0").collect()} == {(k == 0, rows[0][1] if k == 0 else f"Own{k} a{k} b{k}. End{k} c{k}.") for k in range(0, 3000, 500)}


# --- importance ------------------------------------------------------------------


def test_importance_keeps_what_looks_like_the_target(spark):
    rng = random.Random(6)
    good = [(k, " ".join(rng.choice(WORDS) for _ in range(80))) for k in range(150)]
    bad = [(1000 + k, " ".join(rng.choice(["zz", "qq", "xx"]) for _ in range(80))) for k in range(50)] + [(2000, None), (2001, "")]
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good[::3]] + [(k, 0, 0) for k, _ in bad[:16]] + [(2000, None, None)], "doc_id long, quality int, toxic int")
    out = importance.sample_documents(docs_of(spark, good + bad), labels).collect()
    kept = {r.doc_id for r in out}
    assert len(out) == round(50 / 66 * 202) and len({k for k, _ in good} - kept) == 0 and [r.rank for r in sorted(out, key=lambda r: -r.gumbel_key)] == list(range(len(out)))
    assert importance.sample_documents(empty(spark), labels).count() == 0
    assert importance.sample_documents(docs_of(spark, good), labels.limit(0)).count() == 0


def test_importance_never_draws_rows_without_words(spark):
    rng = random.Random(16)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(k, say(60)) for k in range(90)] + [(100 + k, "zz qq " * 30) for k in range(60)] + [(200 + k, rng.choice([None, "", " \n"])) for k in range(30)] + [(5, "zz qq"), (5, "zz qq")]
    labels = spark.createDataFrame([(k, int(k < 90), 0) for k in range(150)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, rows).withColumn("n_grams", F.lit("x")).withColumn("gumbel_key", F.lit(1)).withColumn("_u", F.lit(0))
    out = importance.sample_documents(df, labels).collect()
    assert len(out) == round(0.6 * len(rows)) and {r.doc_id for r in out} >= set(range(90)) - {5} and max(r.doc_id for r in out) < 200
    blank = importance.sample_documents(docs_of(spark, [(1, None), (2, "")]), labels)
    assert blank.count() == 0


def test_importance_of_a_long_text(spark):
    long = " ".join(WORDS * 30_000)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    (r,) = importance.sample_documents(docs_of(spark, [(1, long)]), labels).collect()
    assert r.n_grams == 2 * 12 * 30_000 - 1


def test_gumbel_keys_sample_in_proportion(spark):
    rows = docs_of(spark, [(k, "a" if k % 2 else "b") for k in range(4000)])
    weights = np.zeros(importance.BUCKETS)
    weights[importance.buckets_of("a")] = np.log(3)
    out = importance.resample(importance.weigh(rows, weights), 400).collect()
    assert 0.68 < sum(r.doc_id % 2 for r in out) / 400 < 0.82


# --- FM-index --------------------------------------------------------------------


def test_suffix_order_and_index():
    rng = np.random.default_rng(7)
    for _ in range(20):
        runs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(rng.integers(1, 6))]
        s = np.concatenate([np.append(r, 0) for r in runs]).astype(np.int64)
        order = fm_index.suffix_order(s)
        rank = np.cumsum(s == 0)
        spell = lambda i, s=s, rank=rank: [(0, int(rank[k])) if s[k] == 0 else (1, int(s[k])) for k in range(i, len(s))]
        assert order.tolist() == sorted(range(len(s)), key=spell)
        index = fm_index.Index(s)
        words = [tuple(rng.integers(1, 5, rng.integers(1, 4)).tolist()) for _ in range(10)]
        backward = np.array([list(w[::-1]) + [0] * (3 - len(w)) for w in words])
        low, high, which = index.search(backward, np.array([len(w) for w in words]))
        found = {k: sorted(index.locate(np.arange(a, b)).tolist()) for a, b, k in zip(low, high, which, strict=True)}
        for k, w in enumerate(words):
            assert found.get(k, []) == [i for i in range(len(s)) if tuple(s[i : i + len(w)].tolist()) == w]


def brute_contamination(rows, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w = cut(t)
        hit, names = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    names |= own
        out.append((d, len(w), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize(("block_bytes", "pass_blocks"), [(1 << 20, 16), (60, 1), (60, 2), (60, 100)])
def test_contamination(spark, block_bytes, pass_blocks):
    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(["a", "b", "C", "dé"]) for _ in range(n))
    items = [(k, say(rng.choice([2, 3, 5, 8]))) for k in range(12)] + [(None, "a b"), (90, None), (91, "..."), (3, "b b b C")]
    rows = [(k, say(rng.randrange(0, 40)) + rng.choice(["", ".", "!x"])) for k in range(60)] + [(None, "A-b, c"), (70, None), (71, ""), (72, "q r"), (5, "a b"), (5, "a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, rows).withColumn("items", F.lit(1))
    out = fm_index.find_contamination(df, bench, 4, shard_words=50, block_bytes=block_bytes, pass_blocks=pass_blocks)
    got = [(r.doc_id, r.n_words, r.h, list(r["items"])) for r in out.withColumn("h", fm_index.n_hit(F.col("spans"))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_contamination(rows, items, 4)))
    clean = fm_index.without_spans(out)
    assert clean.count() == len(rows)
    cut = {r.doc_id: r.text for r in clean.collect()}
    assert cut[72] == "q r" and cut[70] is None and cut[5] == ""
    assert fm_index.find_contamination(df, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert fm_index.find_contamination(empty(spark), bench).count() == 0


def test_a_text_longer_than_a_shard(spark):
    rng = random.Random(18)
    say = lambda n: " ".join(rng.choice(["a", "b", "c"]) for _ in range(n))
    items = [(k, say(rng.choice([2, 5, 9]))) for k in range(9)]
    rows = [(k, say(n)) for k, n in enumerate((3, 49, 50, 51, 53, 54, 400, 999))]
    out = fm_index.find_contamination(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"), 5, shard_words=50)
    got = [(r.doc_id, r.n_words, r.h, list(r["items"])) for r in out.withColumn("h", fm_index.n_hit(F.col("spans"))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_contamination(rows, items, 5)))
    for r in out.collect():
        assert all(a.end < b.first for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_a_shard_is_indexed_once_for_all_blocks(monkeypatch):
    rng = random.Random(28)
    say = lambda n: " ".join(rng.choice(["a", "b", "c"]) for _ in range(n))
    items, rows = [(str(k), say(rng.choice([2, 5, 9]))) for k in range(40)], [(k, say(rng.randrange(60))) for k in range(30)]
    made = []
    monkeypatch.setattr(fm_index, "Index", lambda symbols, own=fm_index.Index: made.append(1) or own(symbols))
    blocks = fm_index.Blocks(fm_index.Phrases(items[k : k + 7], 4) for k in range(0, 40, 7))
    got = fm_index.scan_shard([fm_index.words_of(t) for _, t in rows], pickle.loads(pickle.dumps(blocks)))
    assert len(blocks) == 6 and len(made) == 1
    assert [(sum(b - a for a, b in spans), names) for spans, names in got] == [(hit, names) for _, _, hit, names in brute_contamination(rows, items, 4)]


def test_phrases_are_small():
    rng = np.random.default_rng(19)
    items = [(str(k), " ".join(f"w{x}" for x in rng.integers(0, 3000, 400))) for k in range(300)]
    assert len(pickle.dumps(fm_index.Phrases(items))) < 60 * 300 * 391


# --- SimHash ---------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints_against_brute_force():
    texts = [None, "", " \t", "one", "a b c d", "A b C d e", "é É x y z", " ".join(WORDS * 50), "w " * 5000]
    assert simhash.fingerprints_of(texts).tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_forest_against_brute_force(radius):
    rng = np.random.default_rng(9)
    f = [np.uint64(0)]
    for b in rng.integers(0, 2**63, 60):
        f.append(np.uint64(b))
        for _ in range(rng.integers(0, 9)):
            x = f[-1]
            for k in rng.choice(64, rng.integers(1, 7), replace=False):
                x ^= np.uint64(1) << np.uint64(k)
            f.append(x)
    f = np.unique(np.array(f, np.uint64))
    group = np.sort(rng.integers(0, 3, len(f)))
    link = (np.bitwise_count(f[:, None] ^ f[None]) <= radius) & (group[:, None] == group[None])
    want = np.arange(len(f))
    while ((new := np.array([want[x].min() for x in link])) != want).any():
        want = new
    rows, roots = simhash.forest(f, group, 0, radius)
    got = np.arange(len(f))
    got[rows] = roots
    assert (got == want).all()


def test_every_near_pair_shares_a_block_set():
    rng = random.Random(10)
    for blocks in (5, 6, 7):
        sets = simhash.masks(blocks)
        for _ in range(200):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in sets)
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**11)] == [5, 5, 6, 7]


@pytest.mark.parametrize("unit", [8192, 8])
def test_near_duplicates(spark, monkeypatch, unit):
    monkeypatch.setattr(simhash, "UNIT", unit)
    rng = random.Random(11)
    base = [[rng.choice(WORDS) for _ in range(120)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        for j in range(rng.randrange(1, 6)):
            own = list(words)
            for _ in range(j % 3):
                own[rng.randrange(len(own))] = "new"
            rows.append((500 - len(rows), " ".join(own)))
    rows += [(900, None), (901, ""), (902, " "), (None, " ".join(base[0])), (None, "alone with no id"), (7, "twice the same"), (7, "twice the same")]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    prints = np.array([brute_fingerprint(t) for _, t in rows], np.uint64)
    link = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    label = np.arange(len(rows))
    while ((new := np.array([label[x].min() for x in link])) != label).any():
        label = new
    least = {}
    for (i, _), c in zip(rows, label, strict=True):
        least[c] = min((x for x in (i, least.get(c)) if x is not None), default=None)
    want = sorted(repr((i, least[c])) for (i, _), c in zip(rows, label, strict=True))
    assert sorted(repr((r.doc_id, r.component_id)) for r in got) == want
    kept = simhash.first_of_groups(docs_of(spark, rows)).collect()
    assert len(kept) == len(set(label)) and sum(r.doc_id == 7 for r in kept) == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(12)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5), (-3, 10**15), (None, 4)]
    label = {}
    for a, b in edges:
        if a is not None:
            label[a], label[b] = a, b
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if k != v}


# --- language ----------------------------------------------------------------------


def test_gradient_through_time():
    rng = np.random.default_rng(13)
    p = langid.initial(3, 1)
    x, y = rng.integers(1, 255, (5, 64)).astype(np.uint8), rng.integers(0, 3, 5)
    _, g = langid.gradients(p, x, y)
    for k in p:
        for flat in np.argsort(-np.abs(g[k]), axis=None)[:8]:
            at = np.unravel_index(flat, g[k].shape)
            a, b = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
            a[k][at] += 1e-2
            b[k][at] -= 1e-2
            assert abs((langid.gradients(a, x, y)[0] - langid.gradients(b, x, y)[0]) / 2e-2 - g[k][at]) < 0.02 * abs(g[k][at]) + 1e-5


def test_windows_cover_every_byte():
    for n in (0, 1, 63, 64, 65, 1000):
        raw = bytes(range(1, 256)) * 4
        assert langid.windows_of(raw[:n]).tobytes().rstrip(b"\0") == raw[:n]


def test_language_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from gridstream.llm.queries import op10_langid

    out = op10_langid(spark, "/root/testdata/sf0.01").alias("p").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and 0 <= r[1] <= r[2] <= 1


def test_language_of_odd_rows(spark):
    assert not any(map(langid._letter.search, ("\u00bd", "\u00b2\u00b3 \u2460", "\u0661", "_"))) and all(map(langid._letter.search, ("a1", "\u00e9", "\u65e5")))
    rows = [(1, None), (2, ""), (3, "12 .. !"), (4, "hello there my friend"), (4, "hello there my friend")]
    df = docs_of(spark, rows).withColumn("score", F.lit("old")).withColumn("lang", F.lit(None).cast("string"))
    assert langid.learn(df, F.lit(True)) is None
    assert {(r.lang_pred, r.score) for r in langid.identify(df, None).collect()} == {("und", 0.0)}
    some = df.withColumn("lang", F.lit("en"))
    out = langid.identify(some, langid.learn(some, F.lit(True))).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["und", "und", "und", "en", "en"] and out[3] == out[4]
    assert langid.identify(empty(spark), None).count() == 0


def test_every_language_is_learned(spark):
    names = [chr(97 + k // 10) + chr(97 + k % 10) for k in range(70)]
    df = spark.createDataFrame([(k, f"{n} {n} {n}.", n) for k, n in enumerate(names)], "doc_id long, text string, lang string")
    learned, _ = langid.learn(df, F.lit(True), sample=4)
    assert learned == sorted(names)


def test_language_of_a_long_text(spark):
    some = spark.createDataFrame([(k, "the and of to " * 9 if k % 2 else "der und die das " * 9, "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    model = langid.learn(some, F.lit(True))
    out = langid.identify(docs_of(spark, [(1, "der und die das " * 60_000), (2, "the and of to " * 60_000)]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in out] == ["de", "en"]
