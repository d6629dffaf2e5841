"""The Python kernels against brute force; no Spark."""

import base64
import json
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewmill.llm import decontaminate, edit_counts, multi_index, secrets, simple8b, templates, toxicity, words
from reviewmill.llm.encoding import BYTE_BPE, PieceEncoder
from reviewmill.llm.piece_lattice import SPACE, Lattice

quick = settings(max_examples=60, deadline=None)


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder()


@pytest.fixture(scope="module")
def lattice():
    return Lattice()


@quick
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=2500))
def test_simple8b_round_trip(values):
    ids = np.array(values, np.uint64)
    packed, offsets = simple8b.pack(ids)
    assert (simple8b.unpack(packed, offsets, len(ids)) == ids).all()
    blocks = len(offsets) - 1
    for block in range(blocks):
        part = simple8b.unpack(packed, offsets, len(ids), block, block + 1)
        assert (part == ids[block * simple8b.BLOCK:(block + 1) * simple8b.BLOCK]).all()


def test_simple8b_escapes_look_like_headers():
    ids = np.array([1, 2**61, 0, 2**64 - 1, 2**60, 5] * 300, np.uint64)
    packed, offsets = simple8b.pack(ids)
    assert (simple8b.unpack(packed, offsets, len(ids)) == ids).all()


texts = st.text(st.sampled_from("abcé1  \n'!s\t|"), max_size=60)


@quick
@given(st.lists(texts, max_size=5))
def test_piece_encoder_equals_tokenizer(encoder, values):
    values = [*values, "", " lead", "two  spaces", "<|endoftext|> x", "don't, stop!", "a b c"]
    assert encoder.encode(values) == [encoder.whole(value) for value in values]


@quick
@given(texts, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 6), texts.map(lambda t: t[:4])), max_size=4))
def test_edit_counts_equal_encoding_again(encoder, text, wanted):
    edits, at = [], 0
    for start, size, new in sorted(wanted):
        start = min(max(start, at), len(text))
        end = min(start + size, len(text))
        edits.append((start, end, new))
        at = end + 1
        if at > len(text):
            break
    changed = text
    for start, end, new in reversed(edits):
        changed = changed[:start] + new + changed[end:]
    before, after, _ = edit_counts.counted(text, edits, edit_counts.Counts(encoder))
    assert before == len(encoder.whole(text)) // 4
    assert after == len(encoder.whole(changed)) // 4


def test_added_tokens_are_read_as_the_plain_tokenizer_does(encoder):
    plain = Tokenizer.from_file(BYTE_BPE)
    ids = lambda text: plain.encode(text, add_special_tokens=False).ids
    values = ["a <|endoftext|> b", "<|endoftext|>", " x<|endoftext|><|endoftext|> y  z", "<|endoftext| > no", "plain words here", "",
              "  <|endoftext|>\n", "word  <|endoftext|>s"]
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder.encode(values)] == [ids(value) for value in values]
    counts = edit_counts.Counts(encoder)
    for value in values:
        edits = [(0, 1, "<|endoftext|>z")] if value else []
        for change in ([], edits, [(0, min(3, len(value)), "")]):
            after = value
            for start, end, new in change:
                after = after[:start] + new + after[end:]
            assert edit_counts.counted(value, change, counts)[:2] == (len(ids(value)), len(ids(after)))


def test_edits_encode_only_around_them(encoder):
    text = "word " * 2000 + "token = abcdef"
    _, _, again = edit_counts.counted(text, [(10000, 10014, "x")], edit_counts.Counts(encoder))
    assert again < 6


def test_cleanup_edits_cover_repeats_and_private_data():
    line = "this line stands here more than once"
    edits = edit_counts.cleanup_edits(f"{line}\nmail a.b@c.org now\n{line}")
    assert [new for *_, new in edits] == ["[removed]", ""]


def all_scores(lattice, word):
    found = []

    def go(at, score):
        if at == len(word):
            found.append(score)
            return
        if word[at] not in lattice.ids:
            go(at + 1, score + lattice.byte_score * len(word[at].encode()))
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in lattice.ids:
                go(end, score + lattice.ids[word[at:end]][1])

    go(0, 0.0)
    return sorted(found, reverse=True)


@quick
@given(st.text(st.sampled_from("theancio é漢.,"), min_size=1, max_size=9))
def test_n_best_equals_enumeration(text):
    lattice = Lattice(n_best=5)
    full = SPACE + text.replace(" ", SPACE)
    assert [score for score, _ in lattice.best_texts(text)] == pytest.approx(all_scores(lattice, full)[:5])
    for _, ids in lattice.best_texts(text):
        assert lattice.decode(np.array(ids, "<u4").tobytes()) == text


def test_beginnings_of_pieces_are_kept_for_long_words_alone():
    own = Lattice()
    assert own.decode(own.best("some short words")[0]) == "some short words" and "trie" not in vars(own)
    assert own.decode(own.best("x" * 3000)[0]) == "x" * 3000 and "trie" in vars(own)


@quick
@given(st.text(max_size=40))
def test_pieces_decode_to_the_text(lattice, text):
    ids, *_, same = lattice.best(text)
    assert lattice.decode(ids) == text.replace(SPACE, " ")
    assert same == (SPACE not in text)


@quick
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB é\n\t."), max_size=30)), max_size=8), st.sampled_from([3, 8, 1 << 18]))
def test_words_and_shingles(values, piece):
    old, words.PIECE = words.PIECE, piece
    try:
        sets = list(words.shingle_sets(pa.array(values, pa.string())))
    finally:
        words.PIECE = old
    known = {}
    for value, found in zip(values, sets):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), value or "")
        parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        wanted = {tuple(parts[i:i + 5]) for i in range(len(parts) - 4)} or ({tuple(parts)} if parts else set())
        assert len(found) == len(wanted)
        assert known.setdefault(frozenset(wanted), tuple(found)) == tuple(found)
    assert len(set(known.values())) == len(known)


def distance_in(passage, text):
    row = [0] * (len(text) + 1)
    for i, char in enumerate(passage, 1):
        before, row = row, [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (char != text[j - 1]))
    return min(row)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_decontamination_finds_all_within_budget(seed):
    random = np.random.default_rng(seed)
    letters = "abcdefgh "
    make = lambda size: "".join(random.choice(list(letters), size))
    item = " ".join(make(int(random.integers(40, 140))).split())
    passages = decontaminate.Passages([(7, item), (8, make(90))])
    broken = list(item)
    for _ in range(int(random.integers(0, 10))):
        at = int(random.integers(0, len(broken)))
        broken[at:at + int(random.integers(0, 2))] = random.choice(list("xyz"), int(random.integers(0, 2)))
    text = " ".join((make(60) + "".join(broken) + make(60)).split())
    found = {item for _, item, *_ in passages.matches(pa.array([text]))}
    budget = len(item.encode()) * decontaminate.EDIT_PERCENT // 100
    assert (7 in found) == (distance_in(item, text) <= budget)


def test_decontamination_edges():
    passages = decontaminate.Passages([(1, "tiny"), (2, ""), (3, "A long  enough\npassage of some words to be found")])
    rows = pa.array([None, "", "so TINY", "x a LONG enough passage of some words to be found y"], pa.string())
    assert [(row, item, edits) for row, item, edits, _ in passages.matches(rows)] == [(2, 1, 0), (3, 3, 0)]


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else bytes([0x80 + (size.bit_length() + 7) // 8]) + size.to_bytes((size.bit_length() + 7) // 8, "big")
    return bytes([tag]) + head + body


def test_structural_secrets():
    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1]) + bytes(range(40))) for _ in range(4)))
    armoured = base64.b64encode(key).decode()
    ssh = b"".join(len(part).to_bytes(4, "big") + part for part in (b"ssh-ed25519", bytes(range(32))))
    part = lambda value: base64.urlsafe_b64encode(json.dumps(value).encode()).rstrip(b"=").decode()
    token = part({"alg": "HS256", "typ": "JWT"}) + "." + part({"sub": 1}) + ".c2ln"
    kinds = lambda text: [kind for kind, *_ in secrets.structural_spans(text)]
    assert kinds(f"-----BEGIN RSA PRIVATE KEY-----\n{armoured}\n-----END RSA PRIVATE KEY-----") == ["pem"]
    assert kinds(f"key {armoured} end") == ["der"]
    assert kinds(f"hex {key.hex()} end") == ["der"]
    assert kinds("ssh-ed25519 " + base64.b64encode(ssh).decode()) == ["sshkey"]
    assert kinds(f"Bearer {token}") == ["signed"]
    broken = bytearray(key)
    broken[7] ^= 0x10  # the length of the second number
    assert kinds("key " + base64.b64encode(bytes(broken)).decode()) == []
    assert kinds("plain " + "A" * 80 + " " + "ab12" * 20) == []
    assert kinds(token.replace(".", "-")) == []


def test_secrets_in_other_wrappings():
    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1]) + bytes(range(40))) for _ in range(4)))
    plain, field = base64.b64encode(key).decode(), lambda part: len(part).to_bytes(4, "big") + part
    lines = [plain[at:at + 64] for at in range(0, len(plain), 64)]
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(lines) + "\n-----END RSA PRIVATE KEY-----\n"
    ssh = field(b"ssh-ed25519") + field(bytes(range(32)))
    private = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(ssh) + field(bytes(96))
    part = lambda value: base64.urlsafe_b64encode(json.dumps(value).encode()).rstrip(b"=").decode()
    token = part({"alg": "HS256", "typ": "JWT"}) + "." + part({"sub": 1}) + ".c2ln"
    encoded = lambda raw: base64.b64encode(raw).decode()
    wrapped = encoded(pem.encode())
    for secret, kind in [
        (wrapped, "pem"), (encoded(wrapped.encode()), "pem"), (pem.encode().hex(), "pem"), (encoded(private), "sshkey"),
        (private.hex(), "sshkey"), (ssh.hex(), "sshkey"), (key.hex().upper(), "der"), (plain, "der"), (token, "signed"),
        ("\n".join(lines), "der"), ("\r\n  ".join(lines), "der"), ("\\n".join(lines), "der"), ('" +\n    "'.join(lines), "der"),
        ("\n".join(wrapped[at:at + 76] for at in range(0, len(wrapped), 76)), "pem"),
    ]:
        for before, after in [("", ""), ("key: ", " end"), ("key: ", "\nend of it"), ("\"", "\","), ("some words\n", "\n")]:
            text = before + secret + after
            assert secrets.structural_spans(text) == [(kind, len(before), len(before) + len(secret))], (kind, before, secret)
        for before in ("path/", "name-", "name_", "subdomainlong."):
            text = before + secret
            if "\n" not in secret and (kind != "signed" or before[-1] in "-_."):
                found = secrets.structural_spans(text)
                assert [span[0] for span in found] == [kind] and found[0][1] == len(before) and found[0][2] == len(text)
    lost = "-----BEGIN PRIVATE KEY-----\n" + "\n".join(lines) + "\n\nnext text"
    assert secrets.redacted(lost, secrets.structural_spans(lost)) == "-----BEGIN PRIVATE KEY-----\n[secret]\n\nnext text"
    assert secrets.structural_spans("-" * 5000 + "\n" + "word\n" * 5000 + "0" * 5000 + " " + "M" * 5000 + " " + "A" * 5000) == []


def test_base_secrets():
    assert secrets.base_spans('API_KEY: "abc" Token = abcdef ſecret=abcdefg') == [("assign", 15, 29)]
    assert secrets.base_spans("AKIA" + "A" * 16) == [("access", 0, 20)]
    assert secrets.redacted("x password=abcdefg y", secrets.base_spans("x password=abcdefg y")) == "x [secret] y"


def test_machine_learns_a_pair():
    random = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(1500):
        left, right = random.random(2) < 0.5
        filler = " ".join(random.choice(["alfa", "bravo", "carlo", "delta"], 4))
        rows.append(filler + (" slur" if left else "") + (" folk" if right else ""))
        labels.append(int(left and right))
    machine = toxicity.fit(pa.array(rows), np.array(labels))
    low, one, other, both = machine.scores(pa.array(["alfa", "alfa slur", "alfa folk", "alfa slur folk"]))
    assert both > 0.9 and max(low, one, other) < 0.3


def test_machine_without_both_classes():
    assert (toxicity.fit(pa.array(["a", "b"]), np.array([0, 0])).scores(pa.array(["a", None])) < 0.01).all()
    assert (toxicity.fit(pa.array([], pa.string()), np.array([])).scores(pa.array(["a"])) < 0.01).all()


def test_multi_index_misses_nothing_at_full_reach():
    random = np.random.default_rng(5)
    base = random.normal(size=(60, 16))
    points = multi_index.unit(np.concatenate([base + 0.03 * random.normal(size=base.shape) for _ in range(8)]))
    halves = [multi_index.codebook(points[:, :8], 6, 1), multi_index.codebook(points[:, 8:], 6, 2)]
    placed = list(multi_index.MultiIndex(halves, 0.98, 1.0).cells(points))
    for a, b in zip(*np.nonzero(np.triu(points @ points.T >= 0.98, 1))):
        (home_a, to_a), (home_b, to_b) = placed[a], placed[b]
        assert home_a == home_b or (home_b in to_a and home_a in to_b)


def test_main_text():
    page = ("<html><head><title>no</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'>ok?</div>"
            "<main><h2>T &amp; U</h2><p>a <b>b</b>\n c<p>d<aside>side</aside><form>x</form><script>var a='</p>';</script>"
            "<div class=\"comments\"><p>c1</p></div></main><div id=sidebar>s</div></body>")
    assert templates.main_text(page, frozenset()) == "T & U\n\na b c\n\nd"
    assert templates.main_text("", frozenset()) == ""
    assert templates.main_text("<div class='page has-sidebar'><p>in</p><div class='sidebar'>out</div></div>", frozenset()) == "in"
    assert templates.main_text("<div><p>only</p> text", frozenset()) == "only\n\ntext"


@quick
@given(st.lists(st.text(st.sampled_from("theancio é漢.,😀"), min_size=1, max_size=12), min_size=1, max_size=6), st.sampled_from([1, 2, 4]))
def test_words_searched_together_equal_words_alone(words_, n_best):
    lattice = Lattice(n_best=n_best)
    found = lattice.batch.search([SPACE + word for word in words_])
    for at, word in enumerate(words_):
        paths = lattice.paths(SPACE + word)
        ids = tuple(found.ids[found.starts[at]:found.starts[at + 1]].tolist())
        assert found.scores[at] == pytest.approx(paths[0][0]) and found.counts[at] == len(paths)
        assert found.losses[at] == pytest.approx(paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf)
        assert b"".join(lattice.surface[piece] for piece in ids) == (SPACE + word).encode()
        assert len(lattice.paths(SPACE + word)) == 1 or paths[0][0] == paths[1][0] or ids == paths[0][1]


def test_texts_searched_together_equal_texts_alone(lattice):
    texts = ["one two", "", None, "  two  spaces ", "▁mark one", "x" * 5000, "one\ttwo\nthree", " ", "漢字 😀 ok", "one two"]
    found = lattice.best_of(pa.array(texts, pa.string()))
    for row, text in enumerate(texts):
        ids, score, loss, ways, same = lattice.best(text or "")
        own = found["ids"][found["starts"][row]:found["starts"][row + 1]].astype("<u4").tobytes()
        assert (own, found["score"][row], found["loss"][row], found["ways"][row], found["same"][row]) == (ids, score, loss, ways, same)
        words = lattice.words(text or "")
        assert score == pytest.approx(sum(lattice.paths(word)[0][0] for word in words))
        assert lattice.decode(ids) == (text or "").replace(SPACE, " ")


def test_a_zero_character_becomes_its_byte(lattice):
    for text in ("\x00", "a\x00b \x00"):
        ids, *_, same = lattice.best(text)
        assert lattice.decode(ids) == text and same


@pytest.mark.parametrize("size", [249, 300, 400, 500])
@pytest.mark.parametrize("seed", range(5))
def test_decontamination_finds_runs_of_long_items(size, seed):
    random = np.random.default_rng(seed)
    make = lambda count: "".join(random.choice(list("abcdefghijklmnop"), count))
    item = make(1500)
    start = int(random.integers(0, 1500 - size + 1))
    text = make(300) + item[start:start + size] + make(300)
    found = decontaminate.Passages([(7, item)]).matches(pa.array([text, make(900)]))
    assert [(row, name, edits) for row, name, edits, _ in found] == [(0, 7, 0)]


@pytest.mark.parametrize("size", range(13, 17))
def test_decontamination_finds_short_items_with_an_edit(size):
    random = np.random.default_rng(size)
    make = lambda count: "".join(random.choice(list("abcdefghijklmnop"), count))
    for _ in range(30):
        item, at = make(size), int(random.integers(1, size - 1))
        texts = [make(40) + item[:at] + "z" + item[at + 1:] + make(40), make(40) + item[:at] + item[at + 1:] + make(40), make(90)]
        found = decontaminate.Passages([(1, item), (2, make(60))]).matches(pa.array(texts))
        assert [(row, name, edits) for row, name, edits, _ in found] == [(0, 1, 1), (1, 1, 1)]
