"""Periodic runs, secrets and token links against plain versions, alone and as queries."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from posigauge.llm import periodic_runs, secret_scan, token_links
from posigauge.llm.queries import PACKING, QUERIES

SCHEMA = "doc_id long, text string, key string, runs int, secrets string, n_a string, chunk long, _id long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, texts):
    rows = [(i, t, "k", 1, "s", "x", 3, 4) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# periodic runs


def plain_runs(words):
    """[(start, length, period)] by comparing the words with themselves, one period after another."""
    number = {}
    w = np.array([number.setdefault(x, len(number)) for x in words])
    found = {}
    for p in range(1, len(w) // 4 + 1):
        edges = np.diff(np.concatenate([[0], w[:-p] == w[p:], [0]]).astype(int))
        for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            if b + p - a >= max(6, 4 * p):
                found.setdefault((a, b + p), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def split(text):
    return [w.decode() for w in (text or "").encode().split()]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.lists(st.integers(0, 2), max_size=60),
            st.builds(lambda a, b, n, c: a + b * n + c, *[st.lists(st.integers(0, 4), max_size=9)] * 2, st.integers(1, 9), st.lists(st.integers(0, 4), max_size=9)),
        ),
        max_size=5,
    )
)
def test_runs_of_random_words(texts):
    at = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    got = periodic_runs.text_runs(np.array([w for t in texts for w in t], np.int64), at).tolist()
    assert got == [[n, *run] for n, t in enumerate(texts) for run in plain_runs(t)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=80), st.data())
def test_grammar_extensions(words, data):
    symbols, _ = periodic_runs.closed_texts(np.array(words, np.int64), np.array([0, len(words)]))
    grammar = periodic_runs.Grammar(symbols, 2)
    a = data.draw(st.integers(0, len(words) - 2))
    b = data.draw(st.integers(a + 1, len(words) - 1))
    after = next((n for n in range(len(words)) if b + n == len(words) or words[a + n] != words[b + n]), None)
    before = next(n for n in range(len(words) + 1) if a - n < 0 or words[a - n] != words[b - n])
    place = np.array([a + 1]), np.array([b + 1])
    assert grammar.common(*place, 1).tolist() == [after]
    assert grammar.common(*place, -1).tolist() == [before]


def test_grammar_levels_shrink():
    words = np.random.default_rng(1).integers(0, 5, 50_000)
    symbols, _ = periodic_runs.closed_texts(words, np.array([0, len(words)]))
    grammar = periodic_runs.Grammar(symbols, 2)
    assert sum(len(level.symbols) for level in grammar.levels) < 10 * len(words)
    assert len(grammar.levels) < 120


def run_texts():
    rng = random.Random(3)
    word = lambda k: "".join(rng.choices("abcdé", k=k))
    phrase = [word(3) for _ in range(7)]
    texts = [
        None,
        "",
        " \t\n\x0b ",
        "spam " * 20000,
        "x" * 30000,
        " ".join(phrase * 9),
        "\n".join([word(2) for _ in range(40)] + phrase * 5 + [word(2) for _ in range(300)]),
        "no no no no no",
        "no no no no no no",
        "ha\x1cha ha\x85ha   ha ha ha ha ha ha",
    ]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    return [*enumerate(texts), (5, texts[5]), (None, texts[5])]


def test_runs_of_odd_texts(spark):
    got = periodic_runs.periodic_runs(table(spark, run_texts())).collect()
    want = []
    for i, text in run_texts():
        words = split(text)
        runs = plain_runs(words)
        want.append((i, len(words), runs, " ".join(plain_collapse(words, runs))))
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(table(spark, [])).count() == 0


def test_runs_query(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_recompression"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        words = planted(doc_id, split(text))
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = got[doc_id]
        assert r["n_runs"] == len(runs)
        if best is None:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (None,) * 4
        else:
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (*best, 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r["collapsed_sha256"] == sha(" ".join(plain_collapse(words, runs)))
    assert sum(r["n_runs"] > 0 for r in got.values()) > 20


# secrets

BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", 0),
    "hex": (r"[0-9a-f]+", 0),
}
KIND_ORDER = [k.name for k in secret_scan.KINDS]
# Published test vectors of the formats.
WALLET = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
NOTE = "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5"


def plain_base(text):
    """Full searches of the whole text, one kind after another."""
    found = []
    for kind, (pattern, flags) in BASE.items():
        for m in re.finditer(pattern, text or "", flags):
            size = len(m.group(2)) if kind == "assign" else len(m.group())
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), KIND_ORDER.index(kind), m.end()))
    return sorted(found)


def spans(found):
    return ",".join(f"{KIND_ORDER[k]}:{s}:{e}" for s, k, e in found)


def crc_token(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = letters[d] + digits
    return prefix + body + digits


pieces = st.sampled_from(
    "password passwd secret token api_key apikey API_KEY Token = : \" ' AKIA AKIAAKIA 0123456789abcdef abc DEF . é ſecret \n token= secret:".split(" ")
    + [" ", "  ", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "ABCDEFGHIJKLMNOPQRST", "K"]
)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=25).map("".join))
def test_base_secrets_equal_full_searches(text):
    data = text.encode()
    machine = secret_scan.automaton(secret_scan.KINDS)
    got = [
        (len(data[:s].decode()), k, len(data[:e].decode())) for s, k, e in secret_scan.text_spans(machine, data) if k < 3
    ]
    assert got == plain_base(text)


def secret_texts():
    good = crc_token("ghp_", "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    bad = good[:-1] + ("A" if good[-1] != "A" else "B")
    package = crc_token("npm_", "Z" * 30)
    return [
        None,
        "",
        f"é {good} {bad} {good}x",
        f"token={package};",
        f"ü{WALLET}\n{WALLET[:-1]}j {NOTE} {NOTE[:-1]}q",
        "ſecret=abcdefgh SECRET = 'abcdef' secret=abc " + "f" * 24 + " AKIA" + "Q" * 16,
        "deadbeef" * 20000,
        "password=" * 3 + "token=hunter2hunter2",
        "AKIA" * 9,
    ]


def test_secrets_of_odd_texts(spark):
    texts = secret_texts()
    rows = [*enumerate(texts), (2, texts[2]), (None, texts[2])]
    got = secret_scan.find_secrets(table(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["secrets"]] for r in got if r["doc_id"] is not None}
    for i, text in enumerate(texts):
        base = [(KIND_ORDER[k], text[s:e]) for s, k, e in plain_base(text)]
        assert [f for f in found[i] if f[0] in BASE] == base
    good, package = texts[2].split()[1], texts[3][6:-1]
    assert [f for f in found[2] if f[0] not in BASE] == [("host_token", good)]
    assert ("package_token", package) in found[3]
    assert [f for f in found[4] if f[0] not in BASE] == [("wallet_key", WALLET), ("note_key", NOTE)]
    assert len([r for r in got if r["doc_id"] in (2, None) and len(r["secrets"]) == len(found[2])]) == 3
    assert secret_scan.find_secrets(table(spark, [])).count() == 0


def test_bech32_prefix_with_a_digit():
    """The file format's prefix holds letters and hyphens; its code is told from data by the last 1."""
    letters = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
    data = [(7 * n) % 32 for n in range(52)]

    def state(values):
        s = 1
        for v in values:
            top = s >> 25
            s = (s & 0x1FFFFFF) << 5 ^ v
            for i, g in enumerate([0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3]):
                s ^= g if top >> i & 1 else 0
        return s

    prefix = "age-secret-key-"
    high = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]
    end = state(high + data + [0] * 6) ^ 1
    code = data + [end >> 5 * (5 - i) & 31 for i in range(6)]
    key = (prefix + "1" + "".join(letters[c] for c in code)).upper()
    machine = secret_scan.automaton(secret_scan.KINDS)
    assert [k for _, k, _ in secret_scan.text_spans(machine, key.encode())] == [KIND_ORDER.index("file_key")]
    wrong = key[:-1] + ("Q" if key[-1] != "Q" else "P")
    assert secret_scan.text_spans(machine, wrong.encode()) == []


def test_masked_keeps_the_rest(spark):
    texts = secret_texts()
    got = {r["doc_id"]: r for r in secret_scan.masked(table(spark, enumerate(texts))).collect()}
    assert got[0]["text"] is None and got[1]["text"] == "" and got[0]["runs"] == 1
    assert got[4]["text"] == f"ü[wallet_key]\n{WALLET[:-1]}j [note_key] {NOTE[:-1]}q"
    assert got[6]["text"] == "[hex]"


def test_secrets_query(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_secrets"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    seen = collections.Counter()
    for doc_id, text in texts:
        want, r = plain_base(text), got[doc_id]
        counts = collections.Counter(KIND_ORDER[k] for _, k, _ in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(counts[k] for k in BASE)
        assert r["base_sha256"] == sha(spans(want))
        assert ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in BASE) == spans(want)
        seen += counts
    assert sum(seen.values()) > 0


# token links


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    first.encode_special_tokens = True
    plain = [b for low, high in ((33, 126), (161, 172), (174, 255)) for b in range(low, high + 1)]
    letter = {chr(b): b for b in plain}
    letter |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    a_bytes = {i: bytes(letter[c] for c in t) for t, i in first.get_vocab().items() if all(c in letter for c in t)}
    second = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    return first, a_bytes, second


def piece_bytes(piece):
    return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()


def plain_links(libraries, texts):
    """One row per text, token by token."""
    first, a_bytes, second = libraries
    rows, held = [], collections.Counter()
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        sizes = [[len(a_bytes[i]) for i in a], [len(piece_bytes(second.id_to_piece(i))) for i in b]]
        if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(piece_bytes(second.id_to_piece(i)) for i in b) != whole:
            rows.append(None)
            continue
        ends = [np.cumsum(s).tolist() for s in sizes]
        starts = [[0, *e[:-1]] for e in ends]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links, j = [], 0
        for i in range(len(a)):
            while ends[1][j] <= starts[0][i]:
                j += 1
            k = j
            while k < len(b) and starts[1][k] < ends[0][i]:
                links.append((a[i], b[k]))
                k += 1
        groups, shared, at = [], 0, [0, 0]
        for cut in cuts:
            to = [e.index(cut, p) + 1 for e, p in zip(ends, at, strict=True)]
            ga, gb = a[at[0] : to[0]], b[at[1] : to[1]]
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
            shared += len(ga) * len(gb)
            at = to
        rows.append((len(a), len(b), len(cuts), links, shared, sha(";".join(groups))))
        held.update(set(links))
    highest = collections.defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, "", 0, 0))
            continue
        n_a, n_b, n_groups, links, shared, groups = r
        best = sum(held[p] == highest[p[0]] for p in links)
        out.append((n_a, n_b, n_groups, len(links), shared, groups, best, sum(held[p] for p in links)))
    return out


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "n_best", "count_sum"]


def link_query(docs):
    return token_links.token_links(
        docs,
        str(public_tokenizers.path("byte_bpe_50k.json")),
        PACKING["ranks_path"],
        PACKING["pattern"],
        str(public_tokenizers.path("piece_bpe_32k.model")),
    )


def test_links_of_odd_texts(spark, libraries, rows):
    texts = [r[1][:2000] if r[1] else r[1] for r in rows[:40]] + [
        None,
        "",
        " ",
        "a▁b",
        "<|endoftext|> </s><s> <0x41> <unk>",
        "tab\tand\r\nline  two   three x ",
        "日本語テキスト 😀👍🏽 é é ﬁ",
        "x" * 5000,
        "spam " * 3000,
        "\x00\x01",
    ]
    numbered = [*enumerate(texts), (1, texts[1]), (None, texts[1])]
    got = link_query(table(spark, numbered)).collect()
    want = plain_links(libraries, [t for _, t in numbered])
    assert sorted([(r["doc_id"], *(r[f] for f in FIELDS)) for r in got], key=repr) == sorted(
        [(i, *w) for (i, _), w in zip(numbered, want, strict=True)], key=repr
    )
    assert link_query(table(spark, [])).count() == 0


def test_links_query(spark, sf_dir, libraries):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in QUERIES["op13_token_links"](spark, sf_dir).collect()}
    want = plain_links(libraries, [t for _, t in texts])
    assert got == {i: w for (i, _), w in zip(texts, want, strict=True)}


@given(st.integers(0, 6), st.integers(0, 6), st.integers(0, 6), st.data())
def test_product_equals_the_dense_one(n, m, k, data):
    cells = lambda r, c: np.array(data.draw(st.lists(st.booleans(), min_size=r * c, max_size=r * c)), int).reshape(r, c)
    dense_a, dense_b = cells(n, m), cells(m, k)

    def csr(x):
        return token_links.Csr(np.append(0, np.cumsum(x.sum(axis=1))).astype(np.int64), np.nonzero(x)[1], x.shape[1])

    pattern, values = token_links.product(csr(dense_a), csr(dense_b))
    out = np.zeros((n, k), int)
    out[np.repeat(np.arange(n), np.diff(pattern.starts)), pattern.columns] = values
    assert (out == dense_a @ dense_b).all()
    assert (token_links.product_sizes(csr(dense_a), csr(dense_b)) == (dense_a @ dense_b.sum(axis=1)).ravel()).all()
    flipped = token_links.transposed(csr(dense_a))
    assert (np.repeat(np.arange(m), np.diff(flipped.starts)).tolist(), flipped.columns.tolist()) == tuple(
        x.tolist() for x in np.nonzero(dense_a.T)
    )


def test_shared_links_are_those_of_the_groups(libraries):
    vocabularies = token_links.Vocabularies(
        str(public_tokenizers.path("byte_bpe_50k.json")),
        PACKING["ranks_path"],
        PACKING["pattern"],
        str(public_tokenizers.path("piece_bpe_32k.model")),
    )
    links = token_links.link_texts(vocabularies, ["Unbelievably long-winded phrases", None, "日本語 token overlap"])
    a, b = token_links.shared_links(links, slice(2, len(links.a)))
    groups = [
        (range(*links.a_groups.starts[g : g + 2]), range(*links.b_groups.starts[g : g + 2]))
        for g in range(links.a_groups.rows)
    ]
    want = [(i, j) for xs, ys in groups for i in xs for j in ys if i >= 2]
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == want
    assert links.shared.sum() == sum(len(x) * len(y) for x, y in groups)
