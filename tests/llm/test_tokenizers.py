"""Token counts of prefixes and the alignment of two tokenizers against the libraries."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from maskwright.llm import alignment, token_counts
from maskwright.llm.entry import piece_path, tokenizer_path

PARTS = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "▁", " ▁", "é", "日本", "ゼ", "123", "ing", "</s>", "<0x0A>", "<|endoftext|>", "​", "😀", " the", " internation", "al", "\x00", "\r\n", "ﬁ", " Word", "."]


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=piece_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(1500)]


def test_counts_of_all_prefixes(pieces, texts):
    counter = token_counts.PrefixCounter(piece_path())
    for part in (texts[:700], texts[700:], texts):
        raw = [t.encode() for t in part]
        steps, at = counter.count(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        for i, t in enumerate(part):
            assert np.cumsum(steps[at[i] : at[i + 1]]).tolist() == [len(pieces.encode(t[:n])) for n in range(1, len(t) + 1)]


def test_long_units_are_counted_as_short_ones(pieces):
    model = token_counts.piece_model(piece_path())
    units = ["internationalisation" * 9, "日本語" * 50, "a" * 300, " " * 70, "x" * 47, "é▁ ▁b" * 20]
    steps, length = model.steps([*units, "abc", " the"])
    assert length.tolist() == [*map(len, units), 3, 4]
    for unit in units:
        assert model.long_steps(unit).cumsum().tolist() == model.prefix_steps([unit])[0].cumsum().tolist()


def test_token_counts(spark, table, odd_rows, pieces, texts):
    rows = [*odd_rows, *((5000 + i, t) for i, t in enumerate(texts[:200])), (None, "no id")]
    docs = table(rows)
    out = token_counts.token_counts(docs, piece_path(), limit=20).collect()
    plain = Counter()
    for i, t in rows:
        counts = [len(pieces.encode(t[:n])) for n in range(1, len(t) + 1)] if t and len(t) < 2000 else None
        n = len(pieces.encode(t or ""))
        fit = max((k for k, c in enumerate(counts, 1) if c <= 20), default=0) if counts else None
        plain[i, len((t or "").encode()), n, n > 20, fit] += 1
    long = {i for i, t in rows if not t or len(t) >= 2000}
    assert plain == Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, None if r.doc_id in long else r.fit_chars) for r in out)
    assert token_counts.token_counts(docs.limit(0), piece_path()).count() == 0
    stored = {r.doc_id: r for r in token_counts.prefix_counts(docs.filter("doc_id = 5007"), piece_path()).collect()}
    text = texts[7]
    assert [token_counts.prefix_tokens(stored[5007].steps, stored[5007].width, n) for n in range(len(text) + 1)] == [0, *(len(pieces.encode(text[:n])) for n in range(1, len(text) + 1))]


def plain_alignment(texts):
    """Rows of cross_tokens by the libraries and sets of links."""
    a_model, b_model = Tokenizer.from_file(tokenizer_path()), sentencepiece.SentencePieceProcessor(model_file=piece_path())
    a_model.encode_special_tokens = True
    from tokenizers.pre_tokenizers import ByteLevel

    assert len(ByteLevel.alphabet()) == 256
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    names = {i: t for t, i in a_model.get_vocab().items()}
    docs, count = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = [(i, bytes(byte_of[c] for c in names[i])) for i in a_model.encode(whole.decode(), add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()) for i in b_model.encode(t or "") for p in [b_model.id_to_piece(i)]]
        if not t or any(b"".join(x for _, x in side) != whole for side in (a, b)):
            docs.append(None)
            continue
        spans = []
        for side in (a, b):
            at = np.cumsum([0, *(len(x) for _, x in side)]).tolist()
            spans.append([(i, lo, hi) for (i, _), lo, hi in zip(side, at, at[1:], strict=False)])
        cuts = sorted({hi for *_, hi in spans[0]} & {hi for *_, hi in spans[1]})
        text = ";".join("|".join(",".join(str(i) for i, lo, hi in side if begin <= lo and hi <= end) for side in spans) for begin, end in zip([0, *cuts], cuts, strict=False))
        by_b, links = defaultdict(list), Counter()
        for j, lo, hi in spans[1]:
            for x in range(lo, hi):
                by_b[x].append(j)
        last = {}
        for j, (_, lo, hi) in enumerate(spans[1]):
            for x in range(lo, hi):
                last[x] = j
        for i, lo, hi in spans[0]:
            for j in {last[x] for x in range(lo, hi)}:
                links[i, spans[1][j][0]] += 1
        docs.append((len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest()))
        count.update(links.keys())
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = d[3]
            out.append((*d[:3], sum(links.values()), sum(m for p, m in links.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in links.items()), d[4]))
    return out


@pytest.mark.parametrize(("size", "sent"), [(1 << 16, 1 << 20), (64, 40), (7, 0)])
def test_cross_tokens(spark, table, odd_rows, texts, monkeypatch, size, sent):
    """Whole texts and ranges of a few bytes, pairs that are sent and pairs that are joined, give the libraries' rows."""
    monkeypatch.setattr(alignment, "RANGE", size)
    monkeypatch.setattr(alignment, "SENT", sent)
    rows = [(i, t) for i, t in odd_rows if len(t or "") < 5000] + [(5000 + i, t) for i, t in enumerate(texts[:150])] + [(9000, "word " * 300), (9001, "日本" * 200), (9002, "x" * 500)]
    out = alignment.cross_tokens(table(rows), tokenizer_path(), piece_path()).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want = Counter((i, *r) for (i, _), r in zip(rows, plain_alignment([t for _, t in rows]), strict=True))
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in out) == want


def test_cross_tokens_of_an_empty_table(table):
    assert alignment.cross_tokens(table([]), tokenizer_path(), piece_path()).count() == 0


def test_fragments_join_in_any_order(texts):
    v = alignment.Vocabularies(tokenizer_path(), piece_path())
    text = b" " + " ".join(t for t in texts if "▁" not in t).encode()[:20_000].decode("utf-8", "ignore").encode()
    parts = [alignment.range_fragment(v, *r) for r in alignment.ranges(text, 97)]
    left = parts[0]
    for p in parts[1:]:
        left = left.then(v, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = p.then(v, right)
    assert left.whole() == right.whole() == alignment.range_fragment(v, 0, len(text), 0, text).whole()
    assert left.exact and not len(left.suffix.a) and not len(left.prefix.a)
    assert sum(not p.closed or len(p.prefix.a) > 0 for p in parts) > 20
