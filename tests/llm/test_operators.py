"""Every operator against brute force, on texts with nulls, ties, copies and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kinshelf.llm import (
    block_max,
    chat,
    decontaminate,
    difference_cover,
    language,
    pack,
    pii,
    prefix_free,
    simhash,
    toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(rng, n, stock=400):
    return [f"w{int(rng.paretovariate(0.6)) % stock}" for _ in range(n)]


def some_texts(seed=1):
    rng = random.Random(seed)
    texts = [" ".join(words_of(rng, rng.randint(1, 120))) for _ in range(40)]
    passage = " ".join(words_of(rng, 60, 10**6))
    texts += [f"{texts[i]} {passage} {texts[i + 1]}" for i in range(6)]
    texts += [texts[3], texts[3], texts[5] + " x", "", None, " \t\n", "é", "a" * 3000, "ab" * 900, "Ünïcödé " * 60]
    texts += [passage + " " + passage, passage.upper(), "one", " ".join(words_of(rng, 20_000, 10**6))]
    return texts


@pytest.fixture(scope="module")
def texts():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    """The same rows with further columns that are called like results and steps."""
    names = (
        "digest", "_digest", "block", "n", "kept", "n_words", "n_removed", "score", "fp", "fingerprint", "node",
        "_node", "key", "_language", "spans", "row", "predicted", "length", "piece",
    )
    return docs.select("*", *[F.lit("kept as it is").alias(c) for c in names])


# --- Repeated bytes and words


def removed_units(sequences, window):
    seen = Counter()
    for s in sequences:
        seen.update(tuple(s[i : i + window]) for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("window", [40, 200])
def test_repeated_bytes(docs, texts, window):
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in prefix_free.remove_repeated_bytes(docs, window=window).collect()}
    for i, (b, gone) in enumerate(zip(raw, removed_units(raw, window))):
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), sum(gone), spans, kept)


def test_repeated_bytes_that_end_where_a_text_ends(spark):
    """A window at the border of one text may lie within a longer repeat of two others."""
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(900))
    parts = [long, "x" + long + "y", long[200:450], long[100:301] + "q", "z" + long[333:540]]
    raw = [t.encode() for t in parts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(parts)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in prefix_free.remove_repeated_bytes(frame, window=200).collect()}
    assert got == {i: sum(g) for i, g in enumerate(removed_units(raw, 200))}


@pytest.mark.parametrize("window", [8, 35])
def test_repeated_words(docs, texts, window):
    said = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    got = {r.doc_id: r for r in difference_cover.remove_repeated_windows(docs, window=window).collect()}
    for i, (w, gone) in enumerate(zip(said, removed_units(said, window))):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), kept)


@pytest.mark.parametrize("period", [1, 2, 3, 7, 13, 21, 24, 31, 40, 100])
def test_difference_cover(period):
    cover = difference_cover.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


# --- SimHash


def fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    ones = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(nodes, linked):
    label = {x: x for x in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {x: root(x) for x in nodes}


def test_simhash(docs, texts):
    prints = [fingerprint(t) for t in texts]
    n = range(len(texts))
    want = components(n, [(a, b) for a in n for b in n if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in n}


@pytest.mark.parametrize("crowd", [64, 4])
def test_links_of_crowded_fingerprints(spark, crowd, monkeypatch):
    """Crowds are looked up by two bits, and connect as all pairs would."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    prints = {0, -1, 1 << 40}
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(40)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in (q & (2**64 - 1) for q in prints))
    close = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    found = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert {tuple(sorted(r)) for r in found} <= set(close)
    assert components(prints, found) == components(prints, close)


def test_overlapping_personal_data():
    assert pii._cut("4111 1111 1111 1111.joe@x.com", [("card", 0, 19), ("email", 15, 29)]) == "[CARD]"
    assert pii._cut("a bcde f", [("card", 2, 6), ("email", 3, 5), ("url", 4, 6)]) == "a [CARD] f"


def test_one_document_of_each_component_stays(docs, texts):
    prints = [fingerprint(t) for t in texts]
    n = range(len(texts))
    want = components(n, [(a, b) for a in n for b in n if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.without_near_copies(clashing(docs))
    assert got.columns == clashing(docs).columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_near_copies_of_odd_rows(spark):
    rows = [(None, "a b c", 1), (None, "a b c", 1), (4, "a b c", 1), (4, "a b c", 1), (9, None, 1), (8, "", 1), (7, "x", 1)]
    rows += [(None, "y", 1), (None, "y", 1), (2, "z", 1), (2, "z", 2), (3, "z", 0)]
    got = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string, _row int")).collect()
    assert sorted((r[:2] for r in got), key=str) == [(2, "z"), (4, "a b c"), (7, "x"), (8, ""), (None, "y")]
    again = simhash.without_near_copies(spark.createDataFrame(rows[::-1], "doc_id long, text string, _row int")).collect()
    assert sorted(got, key=str) == sorted(again, key=str)


# --- Conversations

TOLD = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello </s> [INST] \\ <<SYS>>"),
    (1, 3, "user", "bye"), (1, 4, "assistant", ""), (2, 0, "user", None), (2, 1, None, "who"), (2, 1, "tool", "[/ROLE] [TEXT] x"),
    (3, 0, "assistant", " spaced \n"), (3, 0, "assistant", " spaced \n"), (3, None, "user", "first"), (None, 0, "assistant", "\\"),
    (4, 0, "us[INST]er", "<s></s>"), (5, 0, "assistant", "x" * 100_000),
]


def test_prefix_targets(spark):
    turns = spark.createDataFrame([(*r, "kept") for r in TOLD], "conv_id long, turn long, role string, text string, piece string")
    got = {r.conv_id: r for r in chat.read_back(chat.chat_examples(turns)).collect()}
    told = defaultdict(list)
    for conv, turn, role, text in TOLD:
        told[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(told)
    for conv, rows in told.items():
        rows.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        replies = "".join(t for _, r, t in rows if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())
        assert row.n_examples == sum(r == "assistant" for _, r, _ in rows)


def test_written_examples_hold_their_context(spark):
    turns = spark.createDataFrame([r for r in TOLD if r[0] == 1], "conv_id long, turn long, role string, text string")
    examples = sorted(chat.write_out(chat.chat_examples(turns)).collect(), key=lambda r: r.position)
    assert [chat.unescaped(e.text[e.loss_start : e.loss_end]) for e in examples] == [TOLD[2][3], ""]
    assert examples[1].text.startswith(examples[0].text)
    body = examples[0].text
    assert sum(body.count(x) for x in ("</s>", "[INST]", "<<SYS>>")) == 3  # one of each, the template's own


# --- Personal data


def base_spans(text):
    out = []
    for kind, pattern in {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_of_random_texts():
    rng = random.Random(11)
    parts = ["@", ".", "a.b", "x@y.z", "+1", "+49 (30) 123-4567", " ", "-", "4111 1111 1111 1111", "10.0.0.1", "999.1.1.1", "é", "0", "12", "\n", "a@b@c.de", "1.2.3.4.5.6.7.8", "%_+-"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [s for s in pii.spans_of(text) if s[0] in pii.BASE] == base_spans(text), text


def test_spans_of_hostile_texts():
    for text in ("1" * 200_000, "a@" * 50_000, "+1 " * 50_000, "1." * 50_000, "a" * 200_000 + "@", "+" + " " * 200_000):
        pii.spans_of(text)


def test_added_spans_and_redaction(spark):
    text = "See https://example.org/a?b=1. Account no: 12345678, IBAN DE89 3704 0044 0532 0130 00; IBAN DE00 3704 0044 0532 0130 00, accountant 12345678"
    found = [(k, text[a:b]) for k, a, b in pii.spans_of(text)]
    assert found == [("url", "https://example.org/a?b=1"), ("account", "12345678"), ("account", "DE89 3704 0044 0532 0130 00")]
    frame = spark.createDataFrame([(1, "é mail a@b.co now"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redacted(pii.with_spans(frame)).collect()}
    assert got == {1: "é mail [EMAIL] now", 2: None, 3: ""}


# --- Decontamination


def test_contained_items(spark):
    rng = random.Random(13)
    items = [words_of(rng, n, 10**6) for n in (5, 6, 9, 12, 25, 60, 200)] + [["two", "words"], [], ["two", "words"]]
    docs = [words_of(rng, 3000, 10**6) for _ in range(8)] + [["Two", "words!"], [], None]
    for i, item in enumerate(items[:7]):
        docs[i][500:500] = item
        docs[7] += item[: max(1, int(len(item) * 0.9))]
    text = [None if w is None else " ".join(w).replace("w1", "W1") for w in docs]
    bench = [" ".join(w) for w in items] + [None]

    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = {
        (i, j, len(s), len(s & d))
        for j, s in enumerate(map(shingles, bench)) for i, d in enumerate(map(shingles, text))
        if s and len(s & d) >= 0.8 * len(s)
    }
    frame = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    tests = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    for bound in (1 << 20, 40):  # one pass, and several
        decontaminate.ITEM_SHINGLES = bound
        got = decontaminate.contained_items(frame, tests).collect()
        assert {tuple(r)[:4] for r in got} == want
        clean = decontaminate.without_items(frame, tests).collect()
        assert {r.doc_id for r in clean} == set(range(len(text))) - {p[0] for p in want}
    decontaminate.ITEM_SHINGLES = 1 << 20


# --- Search


@pytest.mark.parametrize("shard", [16 << 20, 2000])
def test_top_documents(docs, texts, shard, monkeypatch):
    monkeypatch.setattr(block_max, "SHARD_BYTES", shard)
    said = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    n, mean = len(said), sum(map(Counter.total, said)) / len(said)
    df = Counter(w for c in said for w in c)

    def score(q, d):
        out = 0.0
        for w, k in q.items():
            if w in d:
                rarity = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                out += k * rarity * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * d.total() / mean))
        return round(out, 6)

    queries = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = defaultdict(list)
    for r in block_max.top_documents(docs, queries, k=5).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    for q in range(0, n, 7):
        ranked = sorted((-s, d) for d in range(n) if (s := score(said[q], said[d])) > 0)[:5]
        assert [d for _, d, _ in sorted(got[q])] == [d for _, d in ranked]
        assert [s for *_, s in sorted(got[q])] == pytest.approx([-s for s, _ in ranked], abs=2e-6)


def test_blocks_are_pruned_without_loss():
    """With many blocks most are skipped; scores of the best stay exact."""
    rng = np.random.default_rng(1)
    rows = np.repeat(np.arange(4000), 30)
    hashes = rng.zipf(1.3, len(rows)).astype(np.uint64) % np.uint64(5000)
    shard = block_max.Shard(hashes, rows, 4000, 30.0)
    for _ in range(30):
        terms = np.unique(rng.integers(0, 5000, 6).astype(np.uint64))
        weights = rng.random(len(terms)) + 0.1
        exact = np.zeros(4000)
        for t, w in zip(terms, weights):
            tf = np.bincount(rows[hashes == t], minlength=4000)
            exact += w * tf * 2.2 / (tf + 1.2)
        found, scores = shard.top(terms, weights, 10)
        assert np.allclose(scores, exact[found])
        want = set(np.flatnonzero(exact >= np.sort(exact)[-10]) if (exact > 0).sum() > 10 else np.flatnonzero(exact))
        assert want <= set(found.tolist())
        # with a bar, lists that stay below it together are passed over
        for share in (0.3, 0.7, 1.0):
            bar = share * float(np.sort(exact)[-10])
            found, scores = shard.top(terms, weights, 10, bar - 1e-6)
            assert np.allclose(scores, exact[found])
            assert {d for d in want if exact[d] >= bar} <= set(found.tolist())


def test_frequent_words_alone_and_bars_above_all():
    rows = np.repeat(np.arange(200), 3)
    hashes = np.where(np.arange(600) % 3 < 2, np.arange(600) % 3, 50 + rows // 4).astype(np.uint64)
    shard = block_max.Shard(hashes, rows, 200, 3.0)
    for terms in ([0], [0, 1], [60], [0, 60], [999]):
        terms, weights = np.array(terms, np.uint64), np.arange(1.0, len(terms) + 1)
        free = dict(zip(*(x.tolist() for x in shard.top(terms, weights, 3))))
        top = max(free.values(), default=0.0)
        for bar in (0.0, top - 1e-6, top / 2, top + 1):
            got = dict(zip(*(x.tolist() for x in shard.top(terms, weights, 3, bar, shard.sums([(terms, weights)])[0]))))
            assert set(got) >= {d for d, s in free.items() if s >= bar and s >= sorted(free.values())[-3]}
            assert all(abs(free[d] - s) < 1e-9 for d, s in got.items() if d in free)


def test_long_queries_score_few_postings():
    """Frequent words cannot bring a document up, and most postings are never scored."""
    rng = np.random.default_rng(2)
    rows = np.repeat(np.arange(3000), 80)
    common = rng.zipf(1.3, len(rows)) % 300
    topical = 1000 + rows % 60 * 200 + rng.zipf(1.2, len(rows)) % 200
    hashes = np.where(rng.random(len(rows)) < 0.5, common, topical).astype(np.uint64)
    shard = block_max.Shard(hashes, rows, 3000, 80.0)
    df = {t: len(np.unique(rows[hashes == t])) for t in np.unique(hashes).tolist()}
    every = scored = 0
    for doc in range(0, 3000, 200):
        terms = np.unique(hashes[rows == doc])
        weights = np.array([math.log(1 + (3000 - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
        every += sum(df[t] for t in terms.tolist())
        free, scores = shard.top(terms, weights, 10)
        bar, before = float(np.sort(scores)[-10]), shard.scored
        found, again = shard.top(terms, weights, 10, bar - 1e-6, shard.sums([(terms, weights)])[0])
        scored += shard.scored - before
        want = dict(zip(free[scores >= bar].tolist(), scores[scores >= bar]))
        got = dict(zip(found.tolist(), again))
        assert set(want) <= set(got) and all(abs(got[d] - s) < 1e-9 for d, s in want.items())
    assert len(shard.frequent) and scored < 0.2 * every, (scored, every)


# --- Packing


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pack.tokenizer_path(None))
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    rows = pack.pack_documents(docs, capacity=256).collect()
    pieces, room = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes())
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        room[r.sequence_id].append((r.offset, r.length))
    for i, own in enumerate(ids):
        mine = sorted(pieces[i])
        assert [p for p, *_ in mine] == list(range(-(-len(own) // 256)))
        assert [s for _, s, _ in mine] == list(np.cumsum([0, *(n for *_, n in mine)])[:-1])
        assert sum(n for *_, n in mine) == len(own) and all(n == 256 for *_, n in mine[1:])
    for own in room.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(room) <= math.ceil(sum(map(len, ids)) / 256) + 2


def test_units_have_the_tokens_of_whole_texts():
    from tokenizers import Tokenizer

    texts = [*some_texts(2), "a  b\n\n c\t\td", "x y   z 　 q", "\r\n x'll don't  ", " \x1c a \x85b", "<|endoftext|> s", "a  <|endoftext|>  b<|endoftext|>", "日本語 テキスト"]
    tokenizer = Tokenizer.from_file(pack.tokenizer_path(None))
    for row, ids in pack.token_rows(pa.array(texts)):
        assert ids.tolist() == [*tokenizer.encode(texts[row] or "", add_special_tokens=False).ids, 0]
    assert [ids.tolist() for _, ids in pack.token_rows(pa.array(["a <|endoftext|> b"]))] == [[64, 220, 50256, 275, 0]]


def test_plans_use_every_piece_once():
    rng = random.Random(17)
    for capacity, pieces in ((100, 3000), (64, 50), (10, 1000)):
        histogram = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(pieces))
        plan = pack.plan_sequences(dict(histogram), capacity, rounds=40)
        used = Counter()
        for pattern, times in zip(plan.patterns, plan.times):
            assert sum(k * n for k, n in pattern.items()) <= capacity
            used.update({k: n * times for k, n in pattern.items()})
        assert used == histogram
        assert plan.least <= plan.sequences <= 1.02 * plan.least + 1
    assert pack.plan_sequences({}, 10).sequences == 0


# --- Learned scores

TONGUES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["schr", "ung", "keit", "ver"], "cc": ["eau", "oix", "tion", "lle"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(19)
    rows = []
    for i in range(600):
        lang = rng.choice(list(TONGUES))
        text = speech(rng, lang, rng.randint(5, 200))
        toxic = rng.random() < 0.3
        if toxic:
            words = text.split()
            for w in ("idiot", "gromlak", "veshtur"):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        rows.append((i, text, lang, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").cache()


def test_languages_of_unseen_rows(spoken):
    model = language.fit_language(spoken)
    held = language.with_language(spoken.where(language.held_out("doc_id")), model).collect()
    assert len(held) > 60 and all(r.lang == r.lang_pred and 0.5 < r.score <= 1 for r in held)


def test_languages_within_a_text(spoken):
    model = language.fit_language(spoken)
    rng = random.Random(23)
    text = f"{speech(rng, 'aa', 40)} {speech(rng, 'cc', 90)}"
    (_, first, _, of, posterior), = model.word_posteriors(pa.array([text]))
    best = [model.languages[k] for k in posterior.argmax(axis=1)]
    assert sum(a == b for a, b in zip(best, ["aa"] * 40 + ["cc"] * 90)) >= 125
    assert model.predict(pa.array([text]))[0] == ["cc"]


def test_posteriors_are_those_of_the_whole_chain():
    rng = np.random.default_rng(2)
    model = language.LanguageModel(["a", "b", "c"], np.zeros((1 << language.BITS, 3), np.float32), rng.normal(size=(3, 3)))
    lengths = [1, 0, 63, 64, 65, 500, 0, 129]
    of = np.append(0, np.cumsum(lengths))
    emissions = rng.normal(size=(of[-1], 3))
    got, step = model.posteriors(emissions, of), np.exp(model.transitions)
    for a, b in zip(of[:-1], of[1:]):
        ahead, back = [np.full(3, 1 / 3)], [np.ones(3)]
        for e in emissions[a:b]:
            s = (ahead[-1] @ step) * np.exp(e)
            ahead.append(s / s.sum())
        for e in emissions[a:b][::-1]:
            s = step @ (np.exp(e) * back[-1])
            back.append(s / s.sum())
        want = np.array(ahead[1:]).reshape(-1, 3) * np.array(back[: b - a][::-1]).reshape(-1, 3)
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_toxicity_of_unseen_rows(spoken):
    model = toxicity.fit_toxicity(spoken, spoken.select("doc_id", "toxic"))
    held = toxicity.with_toxicity(spoken.where(toxicity.held_out("doc_id")), model).collect()
    assert sum(r.toxic == r.predicted for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def test_isotonic_steps():
    at, value = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 0, 1]))
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()
    assert np.interp([1, 2.5, 4, 5], at, value) == pytest.approx([0, 0.5, 0.5, 1])


# --- Every operator: empty tables, clashing columns, repeated and nameless rows


def every_operator(docs, spark):
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    model = toxicity.fit_toxicity(docs, labels)
    yield prefix_free.remove_repeated_bytes(docs)
    yield difference_cover.remove_repeated_windows(docs)
    yield simhash.simhash_components(docs)
    yield simhash.without_near_copies(docs)
    yield pii.with_spans(docs)
    yield toxicity.with_toxicity(docs, model)
    yield language.with_language(docs, language.fit_language(docs))
    yield decontaminate.contained_items(docs, items)
    yield block_max.top_documents(docs, items.withColumnRenamed("item_id", "query_id"))
    yield pack.pack_documents(docs, rounds=3)


def test_empty_tables(spark):
    for out in every_operator(spark.createDataFrame([], SCHEMA), spark):
        assert out.collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.chat_examples(turns)).collect() == []


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (None, None, None, None, None)]
    rows += [(2, "", "en", "s", 0), (None, "x y z", "en", "s", 5)]
    frame = clashing(spark.createDataFrame(rows, SCHEMA))
    counts = [out.count() for out in every_operator(frame, spark)]
    assert counts[:3] == [5, 5, 5] and counts[3] == 3 and counts[4:7] == [5, 5, 5] and counts[9] == 5
    for out in (prefix_free.remove_repeated_bytes(frame), language.with_language(frame, language.fit_language(frame))):
        assert {r["_digest"] for r in out.select("_digest").collect()} == {"kept as it is"}


def test_und_and_empty_scores(spark, spoken):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "kalomi tulo")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.with_language(frame, language.fit_language(spoken)).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] == "aa"
