"""The training-data operators against brute force, and on odd tables."""

import gzip  # noqa: F401
import hashlib
import json
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from driftline.llm import best_fit, binary_rows, lang_id, media, near_dup, passages, pii, registry, repeats, sentencepiece_bpe, textops, tokens, top_k

LONG = " ".join(random.Random(9).choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(30_000))
ODD = [None, "", " ", "\n\t ", "a", "word " * 7, "tie tie tie tie tie tie", "é" * 150, "😀 ok", "▁ mark ▁", "\0", "x" * 5000, LONG, "a@b.co 10.0.0.1 +1 (269) 555-3296 4111 1111 1111 1111"]
#: Columns whose names our operators might use themselves.
CLASH = ["id", "n", "a", "b", "bands", "key", "h", "doc", "pos", "src", "kind", "ranges", "cuts", "marks", "term", "spans", "host", "suffix", "declared", "letters", "ll", "component_id", "kept", "x.y"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if k % 2 else None, None if k % 3 else "src", k) for k, t in enumerate(ODD)]
    rows += [(None, "no name here", "en", "src", 1), (None, None, None, None, None), (5, ODD[5], None, "src", 5), (5, ODD[5], None, "src", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)]).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


TOKENS = registry.tokenizer("byte_bpe_50k.json")
PIECES = registry.tokenizer("piece_bpe_32k.model")

RUNS = {
    "pii": lambda d: pii.sanitise(d),
    "media": lambda d: media.features(media.encode(d)),
    "passages": passages.passages,
    "remove_passages": passages.remove_passages,
    "near_dup": near_dup.near_duplicates,
    "drop_near": near_dup.drop_near_duplicates,
    "repeats": repeats.deduplicate,
    "sentencepiece": lambda d: sentencepiece_bpe.encode(d, PIECES),
    "matrices": lambda d: binary_rows.matrices(d, TOKENS),
    "packed": lambda d: best_fit.packed(d, TOKENS),
    "language": lambda d: lang_id.fuse(lang_id.document_rows(d), *lang_id.fit(d)),
}
PER_ROW = ["pii", "media", "near_dup", "repeats", "sentencepiece", "language", "remove_passages"]


@pytest.mark.parametrize("name", RUNS)
def test_odd_and_empty_tables(odd, name):
    n = len(RUNS[name](odd).collect())
    assert name not in PER_ROW or n == odd.count()
    assert RUNS[name](odd.limit(0)).collect() == []


# --- 1

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_base_spans(spark, docs, odd):
    hard = ["x a@b.c_d@e.f z@q", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 00256.1.1.1", "4111 1111-1111 1111 4111111111111112 5--6 7", "+1 (269) 555-3296. +12 3 +123456789012345678", "a@a@b.cc", "😀 me@x.org 😀 10.0.0.1", "a." * 3000 + "@b" + ".c" * 4000, "9 " * 5000, "A1" * 4000]
    rng = random.Random(4)
    hard += ["".join(rng.choice("a1.@+ -()_%") for _ in range(300)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in hard], "text string").unionByName(docs.select("text")).unionByName(odd.select("text"))
    for r in df.select("text", pii.joined(pii.base_spans(F.col("text"))).alias("s")).collect():
        want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS for m in re.finditer(p, r.text or "") if valid(k, m.group()))
        assert (r.s or "") == want, r.text


def test_disclosing_terms(spark):
    noise = [f"quite ordinary words number{k} here" for k in range(60)]
    held = [f"Zebulon wrote about quite ordinary things {w} to zeb@corp.org" for w in ("first", "second", "third", "fourth")]
    alone = ["Unique99 person sent secret@lone.org once"]
    df = spark.createDataFrame(list(enumerate(noise + held + alone + held[:1])), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "Zebulon" not in got[60].text and "zeb@" not in got[60].text and "ordinary" in got[60].text
    assert got[64].text == "Unique99 person sent <EMAIL> once"  # one text is no evidence
    assert all(got[k].text == t and not got[k]._pii_added for k, t in enumerate(noise))
    assert got[65].text == got[60].text


def added_spans(rows):
    """Spans of the disclosure analysis by counting pair by pair: kind, start, end of each row."""
    word = regex.compile(pii.WORD)
    found = [[(k, m.start(), m.end(), m.group()) for k, p in PATTERNS for m in re.finditer(p, t or "") if valid(k, m.group())] for t in rows]
    entity = lambda k, v: k + ":" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v))

    def without(t, spans):
        for _, a, b, _ in sorted(spans, key=lambda s: -s[1]):
            t = t[:a] + " " + t[b:] if b <= len(t) else t[:a] + " "
        return t

    df_t = Counter(w for t in rows for w in {m.group() for m in word.finditer((t or "").lower())})
    df_c, joint, texts = Counter(), Counter(), defaultdict(set)
    held = []
    for t, spans in zip(rows, found):
        own = {entity(s[0], s[3]) for s in spans}
        held.append(own)
        said = {m.group() for m in word.finditer(without(t, spans).lower())} if own else set()
        for c in own:
            df_c[c] += 1
            for w in said:
                joint[c, w] += 1
                texts[c, w].add(t)
    told = defaultdict(dict)
    for (c, w), j in joint.items():
        if df_c[c] < len(rows):
            k, chance = len(texts[c, w]), df_c[c] / len(rows)
            told[c][w] = math.log2((k - 1 + chance) / (max(df_t[w], j) - j + k) / chance) / -math.log2(chance)
    out = []
    for t, spans, own in zip(rows, found, held):
        said = {m.group() for m in word.finditer(without(t, spans).lower())} if own else set()
        ratio = {w: max(told[c][w] for c in own if w in told[c]) for w in said if any(w in told[c] for c in own)}
        hits = []
        for m in word.finditer(t or ""):
            r = ratio.get(m.group().lower(), 0)
            if r >= 0.8 and not any(a < m.end() and b > m.start() for _, a, b, _ in spans):
                hits.append(("remove" if r >= 0.95 else "generalise", m.start(), m.end()))
        out.append(sorted(hits))
    return out


def test_added_spans(spark, docs, odd):
    """The whole analysis against counting, with copies, several entities in a text, and terms on both sides of the thresholds."""
    rng = random.Random(31)
    names = [f"Name{k}" for k in range(12)]
    rows = []
    for k in range(400):
        p = rng.randrange(12)
        who = f"{names[p]} of team{p % 4} has p{p}@corp.example" + (f" or +1 (269) 555-32{p + 10}" if rng.random() < 0.5 else "")
        say = " ".join(rng.choice(["plain", "green", "Kim", "x9", f"team{rng.randrange(4)}"]) for _ in range(8))
        say += " " + names[rng.randrange(12)] if rng.random() < 0.01 * p else ""
        rows.append(rng.choice([who + " " + say, say, say + " " + who, say + " 10.0.0." + str(p)]))
    rows += rows[:30] + [None, ""]
    every = rows + [t for _, t in texts(docs)] + [t for _, t in texts(odd)]
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(5)
    want = added_spans(every)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r._pii_added] for r in pii.sanitise(df).collect()}
    assert {k: g for k, g in got.items() if g != want[k]} == {}
    assert {kind for g in want for kind, _, _ in g} == {"remove", "generalise"}


def test_columns_with_our_names(spark):
    df = spark.createDataFrame([("mail a@b.co", 7, 8, "x", 9)], "text string, _pii_spans int, _pii_row int, `c.0` string, n_chars long")
    assert [tuple(r) for r in pii.clean_documents(df).collect()] == [("mail <EMAIL>", 7, 8, "x", 12)]
    with pytest.raises(ValueError, match="other names"):
        pii.sanitise(df)
    (row,) = pii.sanitise(df, "spans", "added").collect()
    assert row._pii_spans == 7 and [s.kind for s in row.spans] == ["email"] and row.added == []
    assert pii.clean_documents(df.select("text")).collect() == [("mail <EMAIL>",)]


def test_two_texts_can_disclose(spark):
    """A rare name in two texts with one address tells it in a large table; in one text it tells nothing, whatever the size."""
    noise = [f"ordinary words number{k} of many" for k in range(3000)]
    rows = noise + ["Quillfeather of many a@b.co", "words Quillfeather number1 a@b.co", "Lonelyname of many c@d.co"]
    got = [r.text for r in pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[:3000] == noise and got[3000:] == ["<NAME> of many <EMAIL>", "words <NAME> number1 <EMAIL>", "Lonelyname of many <EMAIL>"]


def test_many_spans_in_long_texts(spark):
    """Thousands of spans, a text of over a megabyte: same spans and text as by hand."""
    rng = random.Random(32)
    many = " ".join(f"é user{k}@host{k % 7}.example {'x' * rng.randrange(30)} 10.0.{k % 256}.1" for k in range(9000))
    rows = [(1, many), (2, "word " * 260_000 + "me@x.org end"), (3, "me@x.org")]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        spans = [(kind, m.start(), m.end()) for kind, p in PATTERNS for m in re.finditer(p, t) if valid(kind, m.group())]
        assert [(s.kind, s.start, s.end) for s in got[k]._pii_spans] == spans
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: s[1:]):
            if a >= at:
                out += [t[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        assert got[k].text == "".join(out) + t[at:]


def test_short_terms_disclose(spark):
    """A name of two or three characters that occurs with one entity only goes; a short word that is everywhere stays."""
    rows = [(k, f"Ask Kim or Bo at the desk {k}0001, kim.l@corp.example or phone") for k in range(4)] + [(10 + k, f"Nothing at the desk or in box {k}0002") for k in range(60)]
    got = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all({"Kim", "Bo"} <= {s.value for s in got[k]._pii_added} and not {"at", "the", "or"} & {s.value for s in got[k]._pii_added} for k in range(4))
    assert all("Kim" not in got[k].text and " or " in got[k].text for k in range(4))


# --- 2


def test_media_round_trip(odd, docs):
    for df in (odd, docs):
        got = Counter((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.features(media.encode(df)).collect())
        want = Counter()
        for _, t in texts(df):
            b = (t or "").encode()
            p = b + b" " * (-len(b) % 192 if b else 192)
            want[len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
        assert got == want


def bits_of(values):
    s = "".join(values)
    s += "1" * (-len(s) % 8)
    return int(s, 2).to_bytes(len(s) // 8, "big").replace(b"\xff", b"\xff\0")


def test_foreign_jpeg_with_colour_and_ac():
    """A 4:2:0 image of one 16x16 MCU, written bit by bit: luminance DCs 5, -3, 0, 40 with an AC each, chroma DCs."""
    dc, ac = {0: "00", 2: "01", 3: "10", 6: "110"}, {0x00: "0", 0x12: "10"}
    huff = lambda c, codes: bytes([c]) + bytes([sum(len(v) == n for v in codes.values()) for n in range(1, 17)]) + bytes(sorted(codes, key=lambda k: (len(codes[k]), codes[k])))

    def magnitude(v):
        n = abs(v).bit_length()
        return dc[n] + (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")

    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    blocks, last = [], 0
    for v in (5, -3, 0, 40):
        d = v - last
        last = v
        n = abs(d).bit_length()
        dc.setdefault(n, {4: "1110", 5: "11110"}.get(n))
        blocks.append(magnitude(d) + ac[0x12] + "11" + ac[0])
    blocks += [magnitude(2) + ac[0]] * 2
    image = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [16] + [1] * 63)) + seg(0xC0, b"\x08\0\x10\0\x10\x03\x01\x22\0\x02\x11\0\x03\x11\0") + seg(0xC4, huff(0, dc)) + seg(0xC4, huff(0x10, ac)) + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + bits_of(blocks) + b"\xff\xd9"
    (((thumb,),)) = media.thumbnails([image])
    assert thumb.tolist() == [[128 + 10, 128 - 6], [128, 128 + 80]]
    with pytest.raises(ValueError):
        media.thumbnails([b"junk"])


# --- 3


def test_passages_are_found_and_cut(spark, docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shared = [word() for _ in range(60)]
    fuzzy = list(shared)
    for k in (13, 30, 47):
        fuzzy[k] = word()
    del fuzzy[22]
    own = lambda n: [word() for _ in range(n)]
    rows = [(1, own(30) + shared + own(20)), (2, own(80)), (3, own(10) + fuzzy + own(40)), (4, own(5) + shared[:20] + own(30)), (5, shared + own(9))]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.src_doc_id): r for r in passages.passages(df.repartition(3)).collect()}
    assert {k for k, _ in got} == {3, 5} and (got[5, 1].start_word, got[5, 1].end_word, got[5, 1].src_start_word, got[5, 1].identity) == (0, 60, 30, 1.0)
    assert abs(got[3, 1].start_word - 10) <= 1 and abs(got[3, 1].end_word - 69) <= 1 and got[3, 1].identity >= 0.9
    after = dict(texts(passages.remove_passages(df)))
    assert after[5] == " ".join(rows[4][1][60:]) and after[2] == " ".join(rows[1][1]) and after[4] == " ".join(rows[3][1])


def test_passages_twice_in_a_document(spark):
    """Each place counts, in whatever tasks the documents are."""
    rng = random.Random(21)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    line = new(60)
    rows = [(1, " ".join(line + new(30))), (2, " ".join(new(20) + line + new(50) + line + new(20)))]
    for parts in (1, 2):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1) if parts == 1 else spark.createDataFrame(rows[:1], "doc_id long, text string").union(spark.createDataFrame(rows[1:], "doc_id long, text string"))
        assert {(r.doc_id, r.start_word, r.end_word) for r in passages.passages(df).collect()} == {(2, 20, 80), (2, 130, 190)}


def test_passages_whose_seeds_are_first_elsewhere(spark):
    """Parts of a passage, and the seeds over their joints, are in earlier documents; only the last two hold it whole."""
    rng = random.Random(23)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows, need = [], {}
    for parts in ((30, 30), (13, 14, 13), (30, 30, 30)) * 10:
        have = [new(n) for n in parts]
        whole, k = sum(have, []), len(rows)
        pieces = [*have, *(a[-4:] + b[:4] for a, b in zip(have, have[1:])), whole, whole]
        rows += [(k + i, " ".join(new(20) + w + new(20))) for i, w in enumerate(pieces)]
        need[len(rows) - 1] = (20, 20 + len(whole), len(rows) - 2)
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)):
        got = {(r.doc_id, r.start_word, r.end_word, r.src_doc_id) for r in passages.passages(df).collect()}
        assert {(k, *v) for k, v in need.items()} <= got


def test_passages_of_any_split(docs):
    """The result doesn't depend on how the table is split."""
    got = [{tuple(r) for r in passages.passages(docs.repartition(n)).collect()} for n in (1, 7, 31)]
    assert got[0] and got[0] == got[1] == got[2]


def test_passages_that_are_everywhere(spark):
    """A line of thousands of documents, and parts of it that are first alone."""
    rng = random.Random(24)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    parts = [new(20) for _ in range(3)]
    rows = [(k, " ".join(new(10) + p + new(10))) for k, p in enumerate(parts)]
    rows += [(10 + k, " ".join(new(k % 7) + sum(parts, []) + new(5))) for k in range(1500)]
    got = {(r.doc_id, r.start_word, r.end_word) for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert {(10 + k, k % 7, k % 7 + 60) for k in range(1, 1500)} <= got and not any(d <= 10 for d, _, _ in got)


def test_passages_of_one_word_again_and_again(spark):
    """Texts that repeat themselves at every word or two: all of it is covered, by few rows."""
    rng = random.Random(26)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = [(1, ["so"] * 50 + new(20)), (2, new(15) + ["so"] * 300 + new(9)), (3, new(4) + ["on", "and"] * 60 + new(3)), (4, ["on", "and"] * 25 + new(30) + ["on", "and"] * 90)]
    got = defaultdict(list)
    for r in passages.passages(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
    covered = {d: {i for a, b in v for i in range(a, b)} for d, v in got.items()}
    assert covered[2] >= {*range(15, 315)} and covered[4] >= {*range(50), *range(80, 260)} and 1 not in got
    assert all(len(v) < 60 for v in got.values())


def test_long_texts_for_passages(spark):
    """Texts of over a megabyte, one the other's copy but for a word in a thousand."""
    rng = random.Random(25)
    one = [f"v{rng.randrange(10**6)}" for _ in range(170_000)]
    two = [f"z{i}" if i % 1000 == 999 else w for i, w in enumerate(one)]
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    assert len(df.first().text) > 1_000_000
    rest = dict(texts(passages.remove_passages(df)))
    assert rest[1] == " ".join(one) and len(rest[2].split()) < 300


def test_passages_with_many_changed_words(spark):
    """Passages of identity 0.8 and more that share few five-word shingles."""
    rng = random.Random(22)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for n, step in ((60, 6), (60, 7), (60, 8), (100, 7)):
        for _ in range(25):
            one, two = new(n), []
            two = [new(1)[0] if i % step == step - 1 and i < n - 1 else w for i, w in enumerate(one)]
            rows += [(len(rows), " ".join(new(40) + one + new(40))), (len(rows) + 1, " ".join(new(40) + two + new(40)))]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.src_doc_id) for r in got} == {(k + 1, k) for k in range(0, len(rows), 2)}
    assert min(r.identity for r in got) >= 0.8


def test_passages_against_shared_runs(docs):
    """Every document with a run of 50 words that an earlier one has is found."""
    seen, need = {}, set()
    for k, t in sorted(texts(docs)):
        w = t.lower().split()
        for i in range(len(w) - 49):
            g = tuple(w[i : i + 50])
            if seen.setdefault(g, k) != k:
                need.add(k)
    assert need and need <= {r.doc_id for r in passages.passages(docs).collect()}


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not row else row
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        assert passages.common(a, b) == row[-1]


# --- 4


def components(rows, percent=85):
    """Brute force over all pairs: (n, component) by doc_id."""
    sets = {}
    for k, t in rows:
        w = [x for x in re.split("[ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_duplicates_exactly(spark, docs):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(10**6 + k, " ".join(base[: 300 - 7 * k])) for k in range(40)]  # a chain of neighbours that drift away
    for k in range(120):  # one large group of variants
        v = list(base)
        for _ in range(rng.randrange(5)):
            v[rng.randrange(300)] = f"z{k}"
        rows.append((2 * 10**6 + k, " ".join(v)))
    rows += [(3 * 10**6 + k, "few words" if k < 3 else "Few  WORDS") for k in range(5)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    want = components(texts(df))
    got = {r.doc_id: r for r in near_dup.near_duplicates(df).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    assert {r.doc_id for r in near_dup.drop_near_duplicates(df).collect()} == {k for k, (_, c) in want.items() if c == k}


def test_near_duplicates_among_variants_of_a_form(spark):
    """Hundreds of texts of similarity 0.7 share buckets; the few links among them must not depend on a bucket's first centres."""
    rng = random.Random(5)

    def vary(words, k):
        out = list(words)
        for i in rng.sample(range(len(out)), k):
            out[i] = f"x{rng.randrange(10**9)}"
        return out

    form = [f"w{k}" for k in range(120)]
    filled = [vary(form, 2) for _ in range(400)]
    rows = [(k, " ".join(w)) for k, w in enumerate(filled + [vary(w, 1) for w in filled[:100]])]
    want = components(rows)
    assert len({c for _, c in want.values()}) > 300
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_the_pipeline(spark, sf):
    """Its stage takes 0.8, op4 takes 0.85."""
    import corpus_pipeline

    base = [f"w{k}" for k in range(54)]
    other = [f"q{k}" for k in range(54)]
    rows = [(1, base), (2, base[:49] + ["y1", "y2", "y3", "y4", "y5"]), (3, other), (4, other[:47] + [f"z{k}" for k in range(7)])]
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in rows}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.8 <= share(1, 2) < 0.85 and share(3, 4) < 0.8
    df = spark.createDataFrame([(k, " ".join(w), "en", "s") for k, w in rows], "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()} == {1, 3, 4}
    assert all(r.kept for r in near_dup.near_duplicates(df).collect())


def test_near_duplicates_of_nulls(odd):
    got = near_dup.near_duplicates(odd).collect()
    assert all(r.component_id is None and r.kept is None for r in got if r.doc_id is None)
    assert sum(r.doc_id is None for r in near_dup.drop_near_duplicates(odd).collect()) == 2
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id in (0, 1, 2, 3)} == {(0, k) for k in range(4)}


# --- 5


def removed(rows):
    seen, out = set(), {}
    for k, t in sorted(rows):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - 99):
            g = b[i : i + 100]
            if g in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(g)
        kept = bytes(x for x, c in zip(b, hit) if not c)
        out[k] = len(b), sum(hit), sum(c and (not i or not hit[i - 1]) for i, c in enumerate(hit)), hashlib.sha256(kept).hexdigest()
    return out


@pytest.fixture(scope="module")
def repetitive(spark):
    rng = random.Random(3)
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    base = pick("ab ", 3000)
    rows = ["a" * 1000, base, base[500:900] + "x" + base[100:1500], "a" * 150 + "b" + "a" * 150, None, "", base[7:106], base[7:107], "é" * 300, "é" * 51 + "x" + "é" * 80, "ab" * 400, base + base]
    rows += [pick("xyz", rng.randint(20, 90)) + base[1000 : 1000 + rng.randint(80, 260)] + pick("xyz", rng.randint(20, 90)) for _ in range(120)]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)


def test_suffix_ranks():
    rng = np.random.default_rng(4)
    for size in (8, 9, 16, 37, 100):
        raw = rng.integers(97, 99, 700).astype(np.uint8)
        raw[300:500] = raw[20:220]
        strings = [raw[i : i + size].tobytes() for i in range(len(raw) - size + 1)]
        place = {x: k for k, x in enumerate(sorted({*strings}))}
        assert repeats.suffix_ranks(raw, size).tolist() == [place[x] for x in strings]
    assert not len(repeats.suffix_ranks(raw[:50]))


def run_repeats(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.deduplicate(df).collect()}


def test_repeats(docs, repetitive):
    assert run_repeats(repetitive) == removed(texts(repetitive))
    assert run_repeats(docs) == removed(texts(docs))


def test_repeats_with_parts_and_passes(repetitive, monkeypatch):
    """Hot triggers in several parts, long texts in several passes; the functions go to the workers by value."""
    from pyspark import cloudpickle

    monkeypatch.setattr(repeats, "BLOCK", 16)
    monkeypatch.setattr(repeats, "PASS", 700)
    monkeypatch.setattr(repeats, "HELD", 50)
    cloudpickle.register_pickle_by_value(sys.modules["driftline.llm.repeats"])
    try:
        assert run_repeats(repetitive) == removed(texts(repetitive))
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules["driftline.llm.repeats"])


# --- 6


def test_language_held_out(spark, sf, docs):
    langs, model = lang_id.fit(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1 AND length(text) > 100")
    blind = lang_id.document_rows(rest.withColumn("source", F.lit(None).cast("string"))).withColumn("declared", F.lit(None).cast("string"))
    got = lang_id.fuse(blind, langs, model).join(rest.select("doc_id", F.col("lang").alias("was")), "doc_id").collect()
    assert sum(r.lang == r.was for r in got) >= 0.95 * len(got) and all(r.accepted for r in got)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = lang_id.fuse(lang_id.page_rows(pages), langs, model).join(lang_id.page_rows(pages).select("page_id", "declared"), "page_id").collect()
    assert sum(r.lang == r.declared for r in rows) >= 0.9 * len(rows)


def test_evidence_decides_short_texts(spark, docs):
    langs, model = lang_id.fit(docs)
    rows = [(k, "et la", "fr", None, "h1") for k in range(40)] + [(40, "et la", None, None, "h1"), (41, "12 34", "fr", None, "h1"), (42, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    got = {r.doc_id: (r.lang, r.accepted) for r in lang_id.fuse(df, langs, model).collect()}
    assert got[0] == ("fr", True) and got[41] == ("und", False) == got[42]


def fused(rows, langs, table):
    """The fusion row by row; rows: (key, text, declared, suffix, host)."""
    share = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    rows = [(k, *lang_id.log_likelihoods(t, table), d or "", s or "", h or "") for k, t, d, s, h in rows]
    parent = lambda h: h.rsplit(".", 2)[-2] + "." + h.rsplit(".", 1)[-1] if re.search(r"[^.]+\.[^.]+$", h) else ""
    sums = {c: defaultdict(lambda: np.zeros(len(langs))) for c in ("all", "declared", "suffix", "host", "parent")}
    for _, _, ll, d, s, h in rows:
        for c, v in (("all", 0), ("declared", d), ("suffix", s), ("host", h), ("parent", parent(h))):
            sums[c][v] += share(ll)
    total = sums["all"][0]
    base = (total + 1) / (total.sum() + len(langs))
    smooth = lambda v, u: (v + 20 * u) / (v.sum() + 20)
    out = {}
    for k, n, ll, d, s, h in rows:
        told = sum(np.log((sums[c][v] + 1) / (total + len(sums[c]))) for c, v in (("declared", d), ("suffix", s)))
        p = share(ll + told + np.log(smooth(sums["host"][h], smooth(sums["parent"][parent(h)], base))))
        ok = n >= 3 and p.max() >= 0.5
        out[k] = (langs[int(p.argmax())] if ok else "und", float(p.max()), ok)
    return out


ODD_PAGES = [(1, None, None), (2, "", ""), (3, "no address", "<html lang=EN>the and of"), (4, "http://a.b.jp/x", "<p>&amp;</p>"), (5, "https://u@Host.CO.UK:80/?q", "<script>var x</script>l'été où"), (6, "ftp://x", "<" * 3000), (None, None, "der und die"), (7, "http://a.b.jp/x", "<p>&amp;</p>"), (7, "http://a.b.jp/x", "<p>&amp;</p>"), (8, "http://long.ru", "<b>" + "las palabras " * 90_000)]


def test_fusion_of_all_evidence(spark, docs, odd, sf):
    """Posteriors of documents and pages, odd ones among them, against the fusion row by row."""
    langs, model = lang_id.fit(docs)
    assert len(langs) == 4
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(ODD_PAGES, "page_id long, url string, html string"))
    pages = pages.select("*", *[F.lit(k).alias(c) for k, c in enumerate([*CLASH, "text", "lang", "parent", "k", "s", "sums", "prior", "shares"])])
    own = docs.select("doc_id", "text", "lang", "source").unionByName(odd.select("doc_id", "text", "lang", "source"))
    for name, rows in (("page_id", lang_id.page_rows(pages)), ("doc_id", lang_id.document_rows(own))):
        given = [tuple(r) for r in rows.select(name, "text", "declared", "suffix", "host").collect()]
        want = fused([(i, *r[1:]) for i, r in enumerate(given)], langs, model)
        got = Counter((r[0], r.lang, r.accepted, round(r.posterior, 3)) for r in lang_id.fuse(rows, langs, model).collect())
        assert got == Counter((r[0], w[0], w[2], round(round(w[1], 4), 3)) for r, w in zip(given, want.values()))
    assert lang_id.fuse(lang_id.page_rows(pages.limit(0)), langs, model).collect() == []


def test_every_language_of_the_sample_counts(spark):
    """Forty languages, each with words of its own, one of them with few documents."""
    rng = random.Random(12)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(40)] for k in range(40)}
    rows = [(len(words) * i + j, " ".join(rng.choices(w, k=30)), x) for i in range(6) for j, (x, w) in enumerate(words.items()) if i < 2 or j]
    langs, model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    blind = spark.createDataFrame([(j, " ".join(rng.choices(w, k=30)), None, None, None) for j, w in enumerate(words.values())], "doc_id long, text string, declared string, suffix string, host string")
    assert {r.doc_id: r.lang for r in lang_id.fuse(blind, langs, model).collect()} == dict(enumerate(words))


def test_rejection_row_by_row(spark, docs):
    """Rows of one doc_id and of none are decided on by their own evidence."""
    good = docs.filter("length(text) > 200").first()
    rows = [(1, good.text, good.lang, good.source), (1, "12", good.lang, good.source), (1, None, None, None), (None, good.text, good.lang, good.source), (None, "", None, None)]
    kept = lang_id.keep_accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"] and {r.text for r in kept} == {good.text}


def test_common_and_rare_classes(spark, docs, monkeypatch):
    """Classes that are told by a broadcast and classes that are joined by a shuffle get the same results: all of one kind, of the other, and mixed."""
    text = [r.text for r in docs.filter("length(text) > 200").select("text").limit(40).collect()]
    langs, model = lang_id.fit(docs)
    hosts = ["a.one.org"] * 30 + [None] * 30 + [f"h{k}.two.org" for k in range(30)] + [f"h{k}.x{k}.net" for k in range(10)]
    rows = [(i, text[i % 40], [None, "en", "de", f"x{i}"][i % 4], h and h.rsplit(".", 1)[1], h) for i, h in enumerate(hosts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, suffix string, host string")
    want = {i: (w[0], w[2]) for i, w in fused(rows, langs, model).items()}
    for heavy in (0, 3, 8, 10**9):
        monkeypatch.setattr(lang_id, "HEAVY", heavy)
        assert {r.doc_id: (r.lang, r.accepted) for r in lang_id.fuse(df, langs, model).collect()} == want


def test_without_labels(odd):
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    langs, model = lang_id.fit(bare)
    assert langs == [] and {r.lang for r in lang_id.fuse(lang_id.document_rows(bare), langs, model).collect()} == {"und"}


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"type": "BPE", "vocab": {}, "end_of_word_suffix": "</w>"}}])
def test_other_vocabularies_are_refused(tmp_path, change):
    spec = {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "model": {"type": "BPE", "vocab": {}}} | change
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="no plain byte-level vocabulary"):
        tokens.encoder(str(tmp_path / "v.json"))


# --- 7


def test_sentencepiece_is_the_library(odd, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    hard = ["  a  b ", "x\n\ny", "a▁b", "日本語テキスト", "\t tab", "a\0b", "hello  world   foo" + " " * 40 + "bar", "<s> </s> <0x41> <unk>", "a\r\nb", "ﷺ ½ ① ²). x²,", "don't,stop.now!!###"]
    m = sentencepiece_bpe.model(PIECES)
    for t in hard + [t or "" for _, t in texts(odd) + texts(docs)]:
        ids = lib.encode(t)
        assert m.encode(t) == ids and m.decode(ids) == lib.decode(ids)
        assert m.encode_and_decode(t) == (len(ids), ",".join(map(str, ids)), lib.decode(ids))
    rows = sentencepiece_bpe.encode(docs, PIECES).collect()
    known = dict(texts(docs))
    assert all(r.ids == lib.encode(known[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)


# --- 8 and 10


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENS)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_rank_encoder_is_the_tokenizer(ids):
    e = tokens.encoder(TOKENS)
    for t in ["", "<|endoftext|> x<|endoftext|>", "a" * 3000, "  \n\n x", "naïve 😀", "\0", "𝕏 ½ ２"]:
        assert [*e(t).tolist(), 2] == ids(t)


def test_matrices_give_the_documents_back(odd, docs, ids):
    for df in (odd, docs):
        packed = binary_rows.matrices(df, TOKENS, size=512)
        for m in packed.collect():
            assert all(c[0] == 0 and c == sorted(c) and c[-1] <= 512 for c in m.cu_seqlens) and len(m.ids) == 4 * 512 * m.n_rows
        back = defaultdict(Counter)
        whole = defaultdict(dict)
        for r in binary_rows.segments(packed).collect():
            assert r.positions == list(range(len(r.ids)))
            back[r.doc_id][r.piece, r.start, tuple(r.ids)] += 1
            whole[r.doc_id][r.piece] = r.ids
        for k, t in texts(df):
            if k is not None:
                assert sum((whole[k][p] for p in sorted(whole[k])), []) == ids(t)


def test_best_fit_decreasing_takes_the_tightest_room():
    rng = random.Random(1)
    for _ in range(20):
        lengths = [rng.randint(0, 64) for _ in range(200)]
        rows = binary_rows.best_fit_decreasing(lengths, 64)
        assert sorted(i for r in rows for i in r) == list(range(200))
        left: list[int] = []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in left if r >= n and r > 0]
            if fit:
                left.remove(min(fit))
                left.append(min(fit) - n)
            else:
                left.append(64 - n)
        assert len(rows) == len(left)


def test_fullest_combination():
    rng = random.Random(2)
    for _ in range(100):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 10))]
        room = rng.randint(0, 80)
        best = max(s for s in {sum(x for k, x in enumerate(lengths) if m >> k & 1) for m in range(1 << len(lengths))} if s <= room)
        got = best_fit.fullest(dict(Counter(lengths)), room)
        assert sum(got) == best and not Counter(got) - Counter(lengths)


def test_packing(odd, docs, ids):
    for df in (odd, docs):
        rows = best_fit.packed(df, TOKENS).collect()
        places = defaultdict(list)
        for r in rows:
            places[r.sequence_id].append((r.offset, r.length))
        for v in places.values():
            v.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0 and sum(n for _, n in v) <= 1024
        total = sum(r.length for r in rows)
        assert len(places) <= 1.02 * total / 1024 + 3
        by = defaultdict(dict)
        for r in rows:
            by[r.doc_id][r.piece] = r
        for k, t in texts(df):
            if k is None:
                continue
            own, want = [by[k][p] for p in range(len(by[k]))], np.array(ids(t), "<u4")
            assert sum(r.length for r in own) == len(want) and (len(own) == 1 or all(r.length == 1024 for r in own[1:]))
            for r in own:
                data = want[r.start : r.start + r.length].tobytes()
                assert bytes(r.ids) == data and zlib.crc32(data) == r.ids_crc32


def test_packing_of_any_split(docs):
    """At most a hundredth over the least number of sequences, however the table is split."""
    for parts in (1, 16, 64, 211):
        got = best_fit.packed(docs.repartition(parts), TOKENS, ids=False).agg(F.countDistinct("sequence_id"), F.sum("length")).first()
        assert got[0] <= 1.01 * got[1] / 1024 + 1
        rows = binary_rows.matrices(docs.repartition(parts), TOKENS).agg(F.sum("n_rows"), F.sum("n_tokens")).first()
        assert rows[1] == got[1] and rows[0] <= 1.01 * rows[1] / 2048 + 1


# --- 9


def test_top_k(spark, sf):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 16)]) for k in range(400)] + [(k, [0.1] * 16) for k in range(400, 440)]
    rows += [(500, None), (520, [float("nan")] * 16), (540, [None] + [0.0] * 15), (560, [float("inf")] * 16), (580, [1.0] * 3), (600, []), (None, [0.0] * 16), (620, [1e14] * 16), (20, rows[20][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q_ids", F.lit(1)).repartition(4)
    good = [(k, np.floor(64 * np.array(v, np.float32).astype(float)).astype(object)) for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(v, w))), k) for k, w in good if k != q and len(w) == len(v))[:20]
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(scored)]
    got = [tuple(r) for r in top_k.top_k(df).collect()]
    assert [g for g in sorted(got) if g[0] not in (20,)] == [w for w in sorted(want) if w[0] not in (20,) and abs(w[3]) < 2**63]
    assert top_k.top_k(df.limit(0)).collect() == []


def test_search_reads_no_more_than_it_needs():
    """Where few candidates stand out the lists are left early; the answer is that of all products."""
    rng = np.random.default_rng(6)
    flat = rng.integers(-2, 3, (3000, 8))
    peaks = rng.integers(40, 60, (25, 8)) * np.where(np.arange(8) % 2, 1, -1)
    c = np.concatenate([flat, peaks])
    q = np.concatenate([peaks[:5], -peaks[5:10], rng.integers(-50, 50, (5, 8))])
    cid, qid = np.arange(len(c)) * 3, np.array([9000, *range(100_000, 100_014)])
    for block in (slice(None), slice(0, 30), slice(0, 3)):
        got, reads = top_k.search(qid, q, cid[block], c[block], k=20, steps=(0.02, 0.1, 1.0))
        want = []
        for i, v in zip(qid, q):
            want += [(i, k, -s) for s, k in sorted((-int(v @ w), int(k)) for k, w in zip(cid[block], c[block]) if k != i)[:20]]
        assert sorted(got) == sorted(want)
        assert reads <= q.size * len(c[block])
        if block == slice(None):
            assert reads < 0.75 * q.size * len(c)


# --- pipeline


def test_pipeline_stages(spark, odd, docs, sf, ids):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, sf).count() > 0
    # Clashing names but for those of documents; rows that share a doc_id, blank rows.
    for start in (docs, odd, odd.limit(0)):
        stage = start
        for k, (name, f) in enumerate(corpus_pipeline.STAGES):
            before, stage = stage, f(spark, stage, sf)
            if k < 4:
                assert stage.columns == start.columns
                stage = spark.createDataFrame(stage.collect(), start.schema)
            had, has = Counter(texts(before)), Counter(texts(stage)) if k < 4 else None
            if name == "language":
                langs, model = lang_id.fit(before)
                keyed = spark.createDataFrame([(i, *r) for i, r in enumerate(before.select("doc_id", "text", "lang", "source").collect())], "i long, doc_id long, text string, lang string, source string")
                given = [tuple(r) for r in lang_id.document_rows(keyed.withColumn("doc_id", F.col("i"))).select("doc_id", "text", "declared", "suffix", "host").collect()]
                want = fused(given, langs, model)
                assert has == Counter((r.doc_id, r.text) for r in keyed.collect() if want[r.i][2])
                assert start is not docs or sum(has.values()) >= 0.99 * sum(had.values())
            if name == "near_duplicates":
                named = [(i, t) for i, t in had if i is not None]
                want = components([((i, t or ""), t) for i, t in named], 80)
                assert has == Counter({(i, t): n for (i, t), n in had.items() if i is None or want[i, t or ""][1][0] == i})
            if name == "repeated_passages":
                found = defaultdict(list)
                for r in passages.passages(before).collect():
                    found[r.doc_id].append((r.start_word, r.end_word))
                for (i, t), (j, u) in zip(sorted(texts(before), key=str), sorted(texts(stage), key=str)):
                    assert i in found or t == u
                assert start is not docs or found
                for i, t in texts(before):
                    if i in found:
                        w = (t or "").split()
                        left = [x for k, x in enumerate(w) if not any(a <= k < b for a, b in found[i])]
                        assert any(u.split() == left for j, u in texts(stage) if j == i)
            if name == "personal_data":
                assert {(r.doc_id, r.text) for r in pii.sanitise(before).select("doc_id", "text").collect()} == {*has}
                assert stage.filter(F.size(pii.base_spans(F.col("text"))) > 0).count() == 0
            if name == "packing":
                back = defaultdict(list)
                for r in stage.collect():
                    back[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
                for i, t in texts(before):
                    if sum(j == i for j, _ in texts(before)) == 1:
                        assert sum((x for _, x in sorted(back[i])), []) == ids(t)
                assert sum(len(x) for v in back.values() for _, x in v) == sum(len(ids(t)) for _, t in texts(before))


def test_oracles_are_for_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert json.dumps(sorted(registry.queries()))
    assert public_tokenizers.path("piece_bpe_32k.model") == PIECES
    assert len(textops.mix(np.arange(3, dtype=np.uint64))) == 3
