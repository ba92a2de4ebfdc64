"""Operators that look at one text at a time."""

import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from llm import bpe, jpeg, secrets
from llm.words import shingles, word_hashes

LOWER = bytes([c + 32 if 65 <= c <= 90 else c for c in range(256)])


def test_word_hashes_tell_words_apart():
    texts = ["The the THE a", None, "", "x" * 1000 + " y", "abcdefgh abcdefghi Abcdefgh", "é É", "z" * 300 + " " + "z" * 301]
    words, firsts, starts, ends, offsets = word_hashes(pa.array(texts))
    expected = [m for t in texts for m in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER))]
    seen = {}
    for w, h in zip(expected, words.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert list(np.diff(firsts)) == [4, 0, 0, 2, 3, 2, 2]
    runs, to = shingles(words, firsts, 3)
    assert list(np.diff(to)) == [2, 0, 0, 1, 1, 1, 1]


def test_bpe_equals_the_library(spark, odd, nothing, small):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    coder = bpe.ForcedBoundaryBpe(bpe.default_path())
    more = ["don't I'LL 'S 123 ½ ²a é ́x", "\x00\x01 a\x0bb\x1cc\x85d", "ſK K", "q" * 500, "a​b﻿   c", "ǅ Ⅷ ᾳ ẞ", "weiß, çà-et-là"]
    texts = [r.text for r in odd.collect()] + more + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    for t in texts:
        ids = coder.encode(t)
        e = library.encode(t or "", add_special_tokens=False)
        assert ids == " ".join(map(str, e.ids))
        assert library.decode(e.ids, skip_special_tokens=False) == coder.decode(ids)
    got = bpe.encode_documents(odd, ids=True).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r.n_tokens == len(r.token_ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.token_ids)).encode()).hexdigest()
    assert bpe.encode_documents(nothing).count() == 0


@pytest.mark.parametrize("run", ["a", "ha", "-", "the", "0", "é", "zqxj"])
def test_bpe_of_very_long_runs(run):
    coder = bpe.ForcedBoundaryBpe(bpe.default_path())
    began = time.time()
    ids = coder.encode(run * (1_000_000 // len(run)))
    assert time.time() - began < 30 and coder.decode(ids).replace(" ", "").count("</w>") >= 1
    assert not any(len(k) > bpe.BRIEF for k in [*coder._words, *coder._chunks])
    from tokenizers import Tokenizer

    assert coder.encode(run * 3000) == " ".join(map(str, Tokenizer.from_file(bpe.default_path()).encode(run * 3000, add_special_tokens=False).ids))


def test_forced_cuts_are_inside_no_token():
    coder = bpe.ForcedBoundaryBpe(bpe.default_path())
    word = "zqxjkthe"
    parts = coder.fragments(word)
    assert "".join(p for p, _ in parts) == word and len(parts) > 1
    for (a, _), (b, _) in zip(parts, parts[1:], strict=False):
        assert not any(a[-1] + b[0] in t for t in coder.vocab if not t.endswith(coder.suffix))


def test_secrets_equal_plain_scanning(spark, odd, nothing, small):
    texts = ["password = abc123456 token: xy", "secret: pass password=abcdefg", "PASSWORD='Zz9Zz9' ſecret=abcdefgh", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "0123456789abcdef" * 2 + " " + "ab" * 11, "-----BEGIN RSA PRIVATE KEY-----", "https://me:pw123@host/x eyJhbGciOi9.eyJzdWIiOi9.abcdefgh1", "ghp_" + "a1" * 18, None, ""]
    texts += [r.text for r in odd.collect()] + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = secrets.find(pa.array(texts, pa.string()).fill_null(""))
    for t, spans in zip(texts, found, strict=True):
        assert spans == sorted((a, k, b) for k, r in enumerate(secrets.RULES) for a, b in r.spans(t or ""))
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ANY
    assert secrets.trigram_query("(abcd|xyz)q*w") != secrets.ANY
    for query in map(secrets.trigram_query, [r.pattern for r in secrets.RULES]):
        number, codes = secrets.wanted((query,))
        index = secrets.BatchIndex(pa.array(texts, pa.string()).fill_null(""), number, codes)
        low = [(t or "").encode().translate(LOWER) for t in texts]
        assert index.candidates(query).tolist() == [i for i, t in enumerate(low) if any(all(g in t for g in x) for x in query)]
    kinds = {secrets.RULES[k].kind for s in found for _, k, _ in s}
    assert {"assign", "access", "hex", "pem", "jwt", "forge", "login"} <= kinds
    out = {(r.doc_id, r.n_assign) for r in secrets.scan_documents(odd).collect()}
    assert (None, 1) in out and secrets.scan_documents(odd).count() == odd.count()
    clean = secrets.redact_documents(odd)
    assert clean.columns == odd.columns and "hunter2" not in clean.where("doc_id is null").first().text
    assert secrets.redact_documents(nothing).count() == 0
    assert clean.where("doc_id = 2").first().text is None


@pytest.mark.parametrize("run", ["a", "a.", "eyJ", "eyJaaaaaaaa.", "ab://", "token", "token = ", "x:y@", "ghp_", "AKIA", "0f", "xoxb-"])
def test_secrets_in_very_long_runs(run):
    text = run * (5_000_000 // len(run))
    began = time.time()
    for tail in (" ", "://", "://a:b@c", ".eyJ"):
        assert len(secrets.find(pa.array([text + tail]))) == 1
    assert time.time() - began < 40


def test_overlapping_secrets_are_redacted_once():
    text = "token=" + "ab12" * 8 + " end"
    assert secrets.redact(text, secrets.find(pa.array([text]))[0]) == "<assign> end"


@pytest.mark.parametrize("blocks", [1, 2, 6, 7, 97])
def test_jpeg_keeps_every_byte(blocks):
    payload = np.random.default_rng(blocks).integers(0, 256, 64 * blocks, dtype=np.uint8).tobytes()
    media = jpeg.store_payload(payload)
    image = jpeg.read_coefficients(media)
    assert jpeg.payload_of(image) == payload
    assert jpeg.rgb(image).shape == (image.height, image.width, 3)


def test_jpeg_reads_scans_bit_by_bit_alike(monkeypatch):
    media = jpeg.store_payload(np.random.default_rng(0).integers(0, 256, 64 * 13, dtype=np.uint8).tobytes())
    at_once = jpeg.read_coefficients(media)
    monkeypatch.setattr(jpeg, "_read_at_once", lambda *a: False)
    by_bits = jpeg.read_coefficients(media)
    for a, b in zip(at_once.components, by_bits.components, strict=True):
        assert (a.blocks == b.blocks).all()


def test_jpeg_transform_is_the_cosine_transform():
    block = np.zeros(64, np.float32)
    block[0] = 80
    assert np.allclose(block @ jpeg.IDCT, 10)
    assert list(jpeg.ZIGZAG[:6]) == [0, 1, 8, 16, 9, 2] and jpeg.ZIGZAG[63] == 63


def test_media_columns(odd, nothing):
    got = jpeg.media_columns(odd).collect()
    assert len(got) == odd.count()
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in got:
        raw = texts[r.doc_id]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({tuple(r)[1:] for r in got if r.doc_id in (1, 6)}) == 1
    whole = jpeg.media_columns(odd.where("doc_id = 10"), tensors=True).first()
    assert len(whole.tensor) == whole.height * whole.width * 3 and len(whole.media) == whole.media_bytes
    assert jpeg.media_columns(nothing).count() == 0
