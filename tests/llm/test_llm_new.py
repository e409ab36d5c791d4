"""Line dedup, whitening and turn repair against brute force and small cases."""

import gzip
import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from optiq.llm import (bloom, bpe, chat, line_dedup, mixing, near_dedup, shingles, substring_dedup, turn_repair, warc,
                       whitening)
from optiq.session import scratch_path

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\v\f\r"


# ---- lines

def lines_by_hand(docs, min_chars=40, min_docs=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or i is None or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def lines_by_spark(df, **how):
    return Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.row.text or "")
                   for r in line_dedup.drop_repeated_lines(df, **how).collect())


def test_lines_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["x" * 39, "x" * 40, "É" * 40, "\x1c" + "y" * 39, "A long line that many documents share, Nr. %d"]
    pool = [p % i if "%" in p else p for p in pool for i in range(3)] + ["", " ", "short"]
    def line():
        text = rng.choice(pool)
        return rng.choice(["", " ", "\t\v"]) + (text.upper() if rng.random() < .3 else text) + rng.choice(["", "\r", " \f"])
    docs = [(i, "\n".join(line() for _ in range(rng.randint(1, 6)))) for i in range(60)]
    docs += [(7, docs[7][1]), (8, docs[9][1]), (None, docs[1][1]), (None, None), (60, None), (61, ""), (62, "z" * 50 + "\n" * 3),
             (63, "word " * 50_000 + "\n" + pool[4])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = lines_by_hand(docs)
    assert sum(n for _, _, n, _ in want) > 50
    assert lines_by_spark(df) == want
    # filters so small that nearly everything is suspected, and no filters at all
    for bits in (64 * 1024, 0):
        monkeypatch.setattr(bloom, "filter_bits", lambda n, bits=bits: bits)
        assert lines_by_spark(df.repartition(5)) == want
    monkeypatch.undo()
    assert lines_by_spark(df, min_chars=1, min_docs=2) == lines_by_hand(docs, 1, 2)


def test_filter_holds_every_digest_of_two_rows(spark):
    rows = [(i, hashlib.md5(str(j).encode()).digest()) for i in range(8) for j in range(i, 200, 1 + i)]
    df = spark.createDataFrame(rows, "doc_id long, digests binary").repartition(4)
    found = line_dedup.suspects(df, bloom.seen_twice(df, "digests", 1 << 16, 2)).distinct()
    twice = {d for d, n in Counter(d for _, d in rows).items() if n > 1}
    got = {np.array([r.d1, r.d2], "<i8").tobytes() for r in found.collect()}
    assert twice <= got and len(got - twice) < 5
    assert bloom.filter_bits(0) == bloom.LEAST_BITS and bloom.filter_bits(1 << 29) == 0


def test_lines_edges(spark):
    names = ["row", "id", "gone", "of", "d1", "d2", "n", "stays", "hot_stays", "cut", "kept", "n_lines", "digests"]
    same = "a line of more than forty code points in all of them"
    docs = spark.createDataFrame([(i, same + "\nown %d" % i) for i in range(5)], "doc_id long, text string")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    got = {r.row.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert [got[i].n_dropped for i in range(5)] == [1, 1, 1, 1, 0]
    assert got[0].row.text == "own 0" and got[4].row.text.startswith(same) and got[0].row.gone == 2
    first = {r.row.doc_id: r.n_dropped for r in line_dedup.drop_repeated_lines(docs, keep="first").collect()}
    assert [first[i] for i in range(5)] == [0, 1, 1, 1, 1]
    assert line_dedup.drop_repeated_lines(docs.where("false")).collect() == []


# ---- whitening

def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    c = (rng.normal(size=(2500, 24)) @ rng.normal(size=(24, 24))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(c)] + [(9000 + i, c[7].tolist()) for i in range(900)]
    bad = [(None, c[3].tolist()), (-1, None), (-2, [None] * 24), (-3, [math.nan] * 24), (-4, [math.inf] * 24), (-5, [1.0]), (-6, [])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(7)
    out, fit = whitening.whiten(df)
    got = out.collect()
    assert Counter(r.id for r in got) == Counter([i for i, _ in rows] + [None])
    x = np.floor(64 * c.astype(np.float64)).astype(int) + 1_000_000
    x = np.unique(x, axis=0)
    n, s = len(x), x.sum(axis=0)
    assert fit["n"] == n and fit["identity_error"] < 1e-9
    a = (n * x - s) / n
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    assert np.allclose(fit["explained"], e / np.trace(a.T @ a / n), rtol=1e-9)
    by = {r.id: r for r in got}
    for i in (0, 7, 900, 2499):
        own = n * (np.floor(64 * c[i].astype(np.float64)).astype(int) + 1_000_000) - s
        assert by[i].deviation == sum(int(v) ** 2 for v in own)
        assert np.allclose(np.abs(by[i].z), np.abs((own / n) @ u / np.sqrt(e)), atol=1e-8)
    signs = np.sign(np.array(by[0].z) * ((n * (np.floor(64 * c[0].astype(np.float64)) + 1_000_000) - s) / n @ u))
    for i in (1, 2, 3):
        own = (n * (np.floor(64 * c[i].astype(np.float64)) + 1_000_000) - s) / n
        assert np.allclose(np.array(by[i].z) * signs, own @ u / np.sqrt(e), atol=1e-8)
    assert by[7].z == by[9000].z and by[None].z == by[3].z


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>, id int, x int, ids int, z int"
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], schema)
        out, fit = whitening.whiten(df)
        assert out.collect() == [] and fit["explained"] == [], rows
    # a dimension without variance and huge entries: exact sums, no overflow
    rows = [(1, [1e300, 5.0, 0.0]), (2, [-1e300, 5.0, 1.0]), (3, [0.0, 5.0, 7.0])]
    out, fit = whitening.whiten(spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], schema))
    got = out.collect()
    assert len(got) == 3 and all(r.deviation is None for r in got if r.id < 3) and fit["n"] == 3
    rows = [(i, [float(i), 2.0]) for i in range(4)]
    out, fit = whitening.whiten(spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], schema))
    assert [len(r.z) for r in out.collect()] == [1] * 4 and fit["explained"] == [1.0]


def test_exact_deviation():
    c = whitening.Centre(3, [10, 2 ** 63, -5])
    x = np.array([[1, 2 ** 61, 4], [3, 2 ** 62, -9]])
    want = [[3 * int(v) - s for v, s in zip(row, (10, 2 ** 63, -5), strict=True)] for row in x]
    assert c.scaled(x).tolist() == want
    assert c.deviation(x) == [None, None]
    assert whitening.Centre(2, [3, 5]).deviation(np.array([[1, 2], [2, 3]])) == [2, 2]


# ---- turns

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(initials, required, cut):
    """Least (cost, audit) by recursion over the grammar's states."""
    n = len(initials)
    sys.setrecursionlimit(100_000)

    @cache
    def best(i, state, inserted):
        out = [(0, "")] if i == n and state in (0, 3) else []
        def go(i, state, inserted, cost, letter):
            c, a = best(i, state, inserted)
            out.append((c + cost, letter + a))
        if inserted < 3:
            for r in "ua":
                if (state, r) in NEXT:
                    go(i, NEXT[state, r], inserted + 1, 5, "I")
        if i < n:
            go(i + 1, state, 0, 2, "D")
            for r in "sua" if not required[i] else "":
                if (state, r) in NEXT and (r == initials[i] or r != "s"):
                    go(i + 1, NEXT[state, r], 0, (r != initials[i]) + 5 * cut[i], "K" if r == initials[i] else "R")
        return min(out, default=(10 ** 9, ""))

    return best(0, 0, 0)


def conversation_by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, edits = cheapest(tuple(initials), tuple(f in ("blank", "duplicate") for f in fault),
                           tuple(f == "truncated" for f in fault))
    out, length = [], sum(e != "D" for e in edits)
    at = iter(rows)
    for e in edits:
        row = next(at) if e != "I" else None
        if e != "D":
            role = "assistant" if (length - len(out)) % 2 else "user"
            out.append((row[1] if e == "K" else role) + ":" + (row[2] if row else ""))
    turns = [r[0] for r in rows if r[0] is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, fault.count("blank"),
            fault.count("duplicate"), fault.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, edits,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def damaged_by_hand(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += [] if h == 0 else [(turn, "user" if h == 4 else role, "" if h == 1 else
                                         "".join(c for c in text if c not in ".!?") if h == 2 else text)] * (1 + (h == 3))
    return {c: conversation_by_hand(r) for c, r in out.items()}


def by_spark(df):
    found, turns = turn_repair.repair(turn_repair.damaged(df))
    rows = turn_repair.summary(df, found, turns).collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_repair_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    rng = random.Random(2)
    for c in range(1000, 1150):
        rows += [(c, t if rng.random() < .9 else None, rng.choice(["user", "assistant", "system", "tool", None, "", "user", "assistant"]),
                  rng.choice(["Yes.", "No!", "open", "", " \n", None, "Ü?", "a .  ", "x" * 5000 + "."])) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (2000, None, None, None),
             *[(2001, t, "ua"[t % 2] + "x", f"t {t}.") for t in range(700)]]
    rows += rows[-3:]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit(1).alias(c) for c in ("known", "rank", "n", "seen", "place", "h", "copy", "id", "edit")])
    assert by_spark(df) == damaged_by_hand(rows)
    assert by_spark(df.where("false")) == {}


def test_alignment_equals_recursion():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(0, 14)
        initials = [rng.choice("suaat") if rng.random() < .4 else "ua"[i % 2] for i in range(n)]
        required = [rng.random() < .15 for _ in initials]
        cut = [rng.random() < .15 and not r for r in required]
        got = turn_repair.audit(np.array([ord(c) for c in initials], dtype=np.int64), np.array(required, bool), np.array(cut, bool))
        assert got == cheapest(tuple(initials), tuple(required), tuple(cut)), (initials, required, cut)


def test_alignment_over_many_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    initials = np.array([ord("ua"[i % 2]) for i in range(300)])[rng.random(300) > .1]
    required, cut = rng.random(len(initials)) < .05, rng.random(len(initials)) < .05
    whole = turn_repair.audit(initials, required, cut & ~required)
    monkeypatch.setattr(turn_repair, "KEEP", 7)
    assert turn_repair.audit(initials, required, cut & ~required) == whole


@pytest.mark.parametrize("rows, edits, cost", [
    ([], None, None), (["u", "a"], "KK", 0), (["a", "u"], "RR", 2), (["u"], "D", 2), (["s", "u", "a"], "KKK", 0),
    (["s"], "D", 2), (["u", "u", "a"], "DKK", 2), (["a", "u", "a"], "DKK", 2), (["s", "a", "u"], "KRR", 2)])
def test_audits_by_hand(spark, rows, edits, cost):
    if not rows:
        assert turn_repair.audit(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)) == (0, "")
        return
    none = np.zeros(len(rows), bool)
    assert turn_repair.audit(np.array([ord(r) for r in rows]), none, none) == (cost, edits)


# ---- substrings

def chunk_ends(shingler, text, bits=2, longest=16):
    """Places after the last word of each chunk, word by word."""
    values = [int(v) for v in shingler.words([text.encode()])[0]]
    out, since = [], 0
    for i in range(len(values)):
        h = sum(v << j for j, v in enumerate(reversed(values[max(0, i - 3):i + 1]))) % 2 ** 64
        since += 1
        if (h >> (4 - bits)) % 2 ** bits == 0 or since == longest or i + 1 == len(values):
            out.append(i + 1)
            since = 0
    return out


def passages_by_hand(docs, least=20):
    """Repeated passages of (doc_id, text) rows with different ids, from runs of chunks."""
    shingler, first, runs = shingles.Shingler(), {}, []
    for i, text in sorted(docs):
        ends = chunk_ends(shingler, text)
        words, last = text.lower().split(), {}
        for start in [0, *ends[:-1]]:
            end = next((e for e in ends if e - start >= least), None)
            if end is None:
                break
            run = tuple(words[start:end])
            place = first.setdefault(run, (i, start))
            if place[0] != i:
                runs.append((i, start, end, place[0], place[1] - start))
            elif run in last:
                runs.append((i, start, end, i, last[run] - start))
            last[run] = start
    spans = defaultdict(list)
    for i, start, end, of, shift in sorted(runs, key=lambda r: (r[0], r[3], r[4], r[1])):
        held = spans[i]
        if held and held[-1][2:] == [of, shift] and start <= held[-1][1]:
            held[-1][1] = end
        else:
            held.append([start, end, of, shift])
    return sorted((i, a, b - a, of) for i, held in spans.items()
                  for a, b, of in substring_dedup.share_out(sorted((a, b, of) for a, b, of, _ in held), least))


def repeated_texts():
    rng = random.Random(8)
    phrases = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(15, 70))) for _ in range(12)]
    text = lambda: " ".join(rng.choice(phrases) if rng.random() < .4 else f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 40)))
    return [(i, text()) for i in range(120)] + [(500, phrases[0]), (501, phrases[0] + " " + phrases[0]), (502, "w1 " * 300)]


def test_passages_equal_brute_force_in_any_layout(spark, monkeypatch):
    docs = repeated_texts()
    want = passages_by_hand(docs)
    assert len(want) > 60
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for parts, bits in ((1, None), (7, None), (40, 1 << 16), (3, 0)):
        if bits is not None:
            monkeypatch.setattr(bloom, "filter_bits", lambda n, bits=bits: bits)
        got = substring_dedup.repeated_passages(df.repartition(parts, F.rand(parts))).collect()
        assert sorted((r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in got) == want


def test_chunks_do_not_depend_on_neighbours():
    shingler = shingles.Shingler()
    texts = [t.encode() for _, t in repeated_texts()]
    for bits, longest in ((2, 16), (3, 32)):
        alone = [[tuple(map(int, c[1:])) for c in zip(*substring_dedup.chunk(shingler, [t], bits, longest), strict=True)] for t in texts]
        for t in range(1, len(texts)):
            both = zip(*substring_dedup.chunk(shingler, [texts[t - 1], texts[t]], bits, longest), strict=True)
            assert [tuple(map(int, c[1:])) for c in both if c[0] == 1] == alone[t]
    assert [c[0] + c[1] for c in alone[5]] == chunk_ends(shingler, texts[5].decode(), 3, 32)


# ---- mended operators

def test_long_white_space(spark):
    import base64
    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.RANK_FILE), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cases = [a + run + b for a in ("", "a", "a!", "1 ", "\x1c", "é\n") for b in ("", "b", "!", "1", "\x1d", "'s", "\u200b x")
             for run in (" " * 5000, "\n" * 4096, " \n\t\u3000" * 2000, " " * 4095, "\xa0" * 4100)]
    cases += ["x" + " " * 9000 + "y" + "\n" * 9000 + " z", " " * 8192 + " a " + "\r\n" * 5000]
    for t in cases:
        assert "".join(bpe.pieces(t)) == t
    many = [" " * 1_100_000, "a" + "\n" * 1_100_000 + "b", "plain words", " \t" * 600_000 + "c"]
    df = spark.createDataFrame(list(enumerate(cases + many)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.token_digests(df, bpe.Codec(spark)).collect()}
    assert len(got) == len(cases) + 4
    for i, t in enumerate(cases + many):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if i < len(cases) or t == "plain words":
            ids = own.encode_ordinary(t)
            assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), repr(t[:20])
    # the library's own single-piece encoding of what the pattern matches
    ids = own._encode_single_piece(" " * 1_100_000)
    assert got[len(cases)].n_tokens == len(ids)


def test_windows_leave_history_what_the_budget_leaves(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", "w " * (n - 4)) for i, n in enumerate((64, 64, 64, 474, 14))]
    rng = random.Random(1)
    turns += [(c, i, "system" if not i and c % 2 else rng.choice(["user", "assistant"]), "w " * rng.choice([0, 5, 60, 300, 450, 700]))
              for c in range(2, 40) for i in range(rng.randint(1, 12))]
    size = lambda t: len(t.split()) + 4
    made = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    system = {c: size(t) for c, i, r, t in turns if r == "system" and i == 0}
    for r in made:
        pieces = [p.split("\n", 1)[1][:-len("<|im_end|>\n")] for p in r.formatted.split("<|im_start|>")[1:]]
        assert r.n_tokens == sum(map(size, pieces)) and r.over_budget == (r.n_tokens > 512)
        fresh = list(map(size, pieces))[r.n_repeated:]
        if max(fresh) + (system.get(r.conv_id, 0) if r.window else 0) <= 512:
            assert r.n_tokens <= 512, (r.conv_id, fresh)
    assert any(r.n_repeated for r in made) and any(r.over_budget for r in made)


def test_archives_of_repeated_page_ids(spark):
    a, b = "A" * 203, "B" * 303
    pages = spark.createDataFrame([(1, "u", a), (1, "u", b), (2, "u", b), (3, "u", a), (3, "u", a)],
                                  "page_id long, url string, html string")
    path = scratch_path(spark, "warc-ids")
    warc.write(pages, path)
    got = warc.resolved(warc.reassemble(warc.read_records(spark, path))).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [
        (1, 203, "response", 0), (1, 303, "response", 0), (2, 303, "revisit", 1), (3, 203, "revisit", 1), (3, 203, "revisit", 1)]


def test_damaged_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 400) for i in range(6)], "page_id long, url string, html string")
    source = str(tmp_path / "source")
    warc.write(pages.repartition(6), source, file_records=1)
    files = sorted(f for f in os.listdir(source) if f.endswith(".gz"))
    assert len(files) == 6
    whole = {f: open(os.path.join(source, f), "rb").read() for f in files}
    text = {f: gzip.decompress(c) for f, c in whole.items()}
    out = tmp_path / "mixed"
    out.mkdir()
    put = lambda name, data: (out / name).write_bytes(data)
    put("good.gz", whole[files[0]])
    put("members.gz", whole[files[1]] + whole[files[2]][:-40])                     # a cut second member
    put("bits.gz", whole[files[2]][:60] + b"\xff" * 40 + whole[files[2]][100:])    # a damaged one
    put("cut.warc", text[files[3]] + text[files[4]][:200])                         # a cut header or block
    put("noise.warc", text[files[5]] + b"no record\r\n\r\nabc")
    put("empty.warc", b"")
    records = warc.reassemble(warc.read_records(spark, str(out)))
    problems = {r.url.rsplit("/", 1)[1]: r.problem for r in records.where("problem IS NOT NULL").collect()}
    assert set(problems) == {"members.gz", "bits.gz", "cut.warc", "noise.warc"}
    rows = warc.resolved(records).collect()
    page = lambda f: int(text[f].split(b"Optiq-Page-Id: ")[1].split(b"\r")[0])
    assert {page(files[i]) for i in (0, 1, 3, 5)} <= {r.page_id for r in rows}
    assert all(r.payload_bytes == len(f"{r.page_id} " * 400) for r in rows)


def test_archives_are_parsed_in_pieces():
    data = b"".join(warc._record("response", [("WARC-Record-ID", f"<{i}>")], b"x" * (i * 7)) + b"\r\n\r\n" for i in range(30))
    for size in (1, 2, 3, 17, 1000):
        found = list(warc.parse(data[i:i + size] for i in range(0, len(data), size)))
        assert [len(r["block"]) for r in found] == [i * 7 for i in range(30)]


def test_one_of_equal_rows_stays(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a"), (1, text, "a"), (1, "other words of the same id here", "a"), (2, None, "b"), (2, None, "b"), (2, "", "b"),
            (3, "unique text that stands once only", "c"), (4, text, "c"), (None, text, "d"), (None, text, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("many", F.lit(1))
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(
        [(1, text), (1, rows[2][1]), (2, None), (2, ""), (3, rows[6][1]), (None, text), (None, text)])


def test_mix_of_equal_rows_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 40), "abc"[i % 3]) for i in range(300)]
    rows += [rows[i] for i in range(0, 300, 4) for _ in range(rng.randint(1, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    got = Counter()
    for r in mixing.mix(docs).collect():
        got[r.source] += len(r.text.split())
    targets = {r.source: r.target for r in mixing.allot(docs.select(
        "doc_id", "source", mixing.size_of(F.col("text")).alias("size"))).select("source", "target").distinct().collect()}
    assert all(abs(got[s] - targets[s]) <= 6 * 40 for s in size), (got, targets)
