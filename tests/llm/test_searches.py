"""Whole searches of op7 and op8 against plain ones."""

import hashlib
import random
import re
import time

import public_tokenizers as P
from pyspark.sql import functions as F

from quillgraph.llm import byte_bpe, decontaminate, secrets


def _distance(item, text):
    """Least edit distance of item to any part of text, cell by cell."""
    above = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        row = [i + 1]
        for j, b in enumerate(text):
            row.append(min(above[j] + (a != b), above[j + 1] + 1, row[j] + 1))
        above = row
    return min(above)


def test_leaks_against_plain_distance(spark):
    chance = random.Random(7)
    word = lambda: "".join(chance.choice("abcde") for _ in range(chance.randrange(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 8, 12, 20) for _ in range(3)] + [None, "", "  "]

    def changed(item):
        signs = list(item)
        for _ in range(chance.randrange(0, 2 + len(item) // 9)):
            at = chance.randrange(len(signs) + 1)
            signs[at : at + chance.randrange(2)] = chance.choice([[], ["x"], ["y"]])
        return "".join(signs)

    docs = [(k, " ".join([word(), changed(chance.choice([i for i in items if i and i.strip()])).upper(), "\n", word()])) for k in range(60)] + [(60, None), (61, "")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), block_chars=300)
    want = set()
    for k, text in docs:
        for i, item in enumerate(items):
            item = decontaminate.normal(item)
            if item and (far := _distance(item, decontaminate.normal(text))) <= int(len(item) * decontaminate.ERROR_RATE):
                want.add((k, i, far))
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want and len(want) > 40
    assert decontaminate.budget(25) == 2 and decontaminate.budget(19) == 1


def test_secrets_in_made_configurations():
    """Lines of which it is known what they assign; a plain reading of each line names the spans."""
    chance = random.Random(9)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ['{n} = "{v}"', "{n}: {v}", "export {n}={v}", '"{n}": "{v}",', '{n} += "{v}"', "{n} ?= {v}", '<add key="{n}" value="{v}"/>', "{n} := '{v}'", '{n}: str = "{v}"', '{n} = "{v}" # note']
    for _ in range(300):
        name = chance.choice(["db_password", "apiToken", "CLIENT_SECRET", "title", "colour", "retries"])
        value = "".join(chance.choice(sign) for _ in range(20)) + "aB3"
        line = chance.choice(forms).format(n=name, v=value)
        text = f"first line\n{line}\nlast line"
        want = {(text.index(value), text.index(value) + len(value))} if name not in ("title", "colour", "retries") else set()
        assert secrets.literal_spans(text) == want, line
        carried = f'x = "{value}"\ny = x\n{name} = y\n'
        assert secrets.literal_spans(carried) == ({(5, 5 + len(value))} if want else set())
    assert secrets.literal_spans('password = os.getenv("SOME_PASSWORD_X1")') == set()


def test_base_spans_against_plain_search():
    chance = random.Random(2)
    parts = ["password=", "Token: ", 'API_KEY="', "AKIA", "0123456789abcdef", "deadbeef", "ZZ9", "abc.def/gh", " ", "\n", "secret", ":", "=", '"', "A1B2C3D4E5F6G7"]
    for _ in range(400):
        text = "".join(chance.choice(parts) for _ in range(chance.randrange(1, 14)))
        want = []
        for kind, pattern, fits in (
            (0, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
            (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
            (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
        ):
            want += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if fits(m)]
        assert secrets.base_spans(text) == sorted(want)


def test_nested_blocks_are_read_once():
    def took(levels):
        text = "".join(" " * k + f"k{k}: |\n" for k in range(levels)) + " " * levels + "password: |\n" + " " * (levels + 2) + "Zk83jfLq0aPz9\n"
        began = time.perf_counter()
        spans = secrets.literal_spans(text)
        at = text.index("Zk83")
        assert (at, at + 13) in spans
        return (time.perf_counter() - began) / len(text)

    took(100)
    assert took(1200) < 20 * took(150)


def test_a_document_is_decoded_as_a_whole(spark):
    """Characters whose bytes lie in several tokens, and ids that break off within one."""
    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        codec = byte_bpe.ByteBpe(f.read(), P.PATTERN)
    chance = random.Random(4)
    for _ in range(50):
        text = "".join(chance.choice(["a", " ", "é", "漢", "😀", "\n", "word", "́", "ക"]) for _ in range(40))
        single = [codec.ranks[bytes([b]).decode("latin-1")] for b in text.encode()]
        assert codec.decode_text(codec.encode(text)) == text == codec.decode_text(single) == "".join(codec.decode_stream(single))
        cut = single[: chance.randrange(len(single))]
        assert codec.decode_text(cut) == codec.decode_bytes(cut).decode("utf-8", "replace") == "".join(codec.decode_stream(cut))
    row = byte_bpe.round_trip_digest(spark.createDataFrame([(1, "é漢 😀")], "doc_id long, text string"), path, P.PATTERN).select(F.col("decoded_sha256")).first()
    assert row[0] == hashlib.sha256("é漢 😀".encode()).hexdigest()
