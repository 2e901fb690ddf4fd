import hashlib
import random
from collections import Counter

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from presswork.llm import crosstok, registry
from presswork.llm.common import table

from .conftest import frame, same_rows

A_PATH, B_PATH = crosstok.default_tokenizers()
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def bytes_of_a(tokenizer):
    """Bytes of a byte-level token: one letter stands for each byte."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    return lambda i: bytes(letters[c] for c in tokenizer.id_to_token(i))


def brute(rows):
    """Per document, by looking at every byte."""
    a_tok, b_tok = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_tok.encode_special_tokens = True
    a_bytes = bytes_of_a(a_tok)
    b_bytes = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    docs, held, lines = [], Counter(), []
    for key, t in rows:
        if not t:
            docs.append((key, [], [], [], []))
            continue
        a, b = a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)
        raw = (" " + t).encode()
        owner_a, owner_b = ([k for k, i in enumerate(ids) for _ in f(i)] for ids, f in ((a, a_bytes), (b, b_bytes)))
        if b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            docs.append((key, [], [], [], []))
            continue
        links = sorted(set(zip(owner_a, owner_b)))
        both = [k + 1 for k in range(len(raw)) if k + 1 == len(raw) or owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1]]
        groups, at = [], 0
        for end in both:
            groups.append([sorted({o[k] for k in range(at, end)}) for o in (owner_a, owner_b)])
            at = end
        docs.append((key, a, b, groups, [(a[x], b[y]) for x, y in links]))
        held.update({(a[x], b[y]) for x, y in links})
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    for key, a, b, groups, links in docs:
        said = ";".join(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y) for x, y in groups)
        lines.append(dict(zip(COLUMNS, (key, len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links),
                                        sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))))
    return lines


def texts(rng, n):
    parts = ["the", " ", "  ", "\n", "中文", "é", "😀", "don't", "<|endoftext|>", "<s>", "12345", "...", "\t", "naïve", "Ünïcödé", " of", "XYZ", "\x00", "　", "кот"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def test_the_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = registry.op11_token_align(spark, sf)
    assert got.columns == COLUMNS
    same_rows(got, brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]))


def test_edge_rows(spark, docs, no_docs):
    same_rows(crosstok.digest(docs), brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert crosstok.digest(no_docs).collect() == []


def test_odd_texts_marks_and_long_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crosstok, "BLOCK_BYTES", 1000)  # many blocks a task
    rng = random.Random(4)
    rows = [(k, t) for k, t in enumerate(texts(rng, 300))]
    rows += [(300, "a ▁ mark"), (301, "x" * 9000 + " y"), (302, " " * 5000), (303, "中" * 3000), (304, "é😀" * 1500), (304, "é😀" * 1500), (None, "the the"), (None, None), (305, "")]
    df = frame(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in rows])
    same_rows(crosstok.digest(df), brute(rows))


def test_only_rows_without_tokens(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "▁")]
    same_rows(crosstok.digest(frame(spark, tmp_path, [(i, t, "en", "s", 0) for i, t in rows])), brute(rows))


def test_divide_finds_every_common_end():
    rng = np.random.default_rng(3)
    for _ in range(300):
        edges, a_ends, b_ends, a_edges, b_edges = 0, [], [], [0], [0]
        for _ in range(rng.integers(1, 5)):
            size = int(rng.integers(1, 60))
            for ends, marks in ((a_ends, a_edges), (b_ends, b_edges)):
                inner = rng.choice(np.arange(1, size), rng.integers(0, size), replace=False) if size > 1 else []
                ends += [edges + int(x) for x in sorted(inner)] + [edges + size]
                marks.append(len(ends))
            edges += size
        a_ends, b_ends, a_edges, b_edges = map(np.array, (a_ends, b_ends, a_edges, b_edges))
        last_a, last_b = crosstok.divide(a_ends, b_ends, a_edges, b_edges)
        common = np.intersect1d(a_ends, b_ends)
        assert a_ends[last_a].tolist() == common.tolist() == b_ends[last_b].tolist()


def test_groups_of_a_text():
    (got,) = crosstok.groups(["unbelievable tokenizers"])
    aligner = crosstok.Aligner(A_PATH, B_PATH)
    spell = lambda table, ids: b"".join(table[i] for i in ids)
    assert all(spell(aligner.a.bytes, a) == spell(aligner.b.bytes, b) for a, b in got)
    assert spell(aligner.a.bytes, [i for a, _ in got for i in a]) == b" unbelievable tokenizers"


def test_packing():
    rng = np.random.default_rng(5)
    for numbers in (np.zeros(0, np.int64), np.array([0]), rng.integers(0, 1 << 40, 1000), rng.integers(0, 3, 77)):
        assert crosstok._unpacked(crosstok._packed(numbers)).tolist() == numbers.tolist()
