"""Texts without blanks and long runs of blanks: ids equal the library, in time in proportion to the text."""

import base64
import random
import time

import pytest

from mirrorset.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return pieces.Encoder(pieces.load_model(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


def samples(n):
    rng = random.Random(4)
    return {
        "chinese": "".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.3 else rng.choice("的一是在不了有和人这中大为上个国我以要他") for _ in range(n)),
        "thai": "".join(chr(rng.randrange(0x0E01, 0x0E2F)) if rng.random() < 0.7 else rng.choice("ะาิีึืุูเแโใไ") for _ in range(n)),
        "base64": base64.b64encode(rng.randbytes(3 * n // 4)).decode(),
        "letters": "".join(rng.choice("etaoinshrdlu") for _ in range(n)),
        "one letter": "a" * n,
        "period": "abcab" * (n // 5),
        "code": "for(i=0;i<n;i++){x[i]=y[i]*z[i];}" * (n // 33),
        "blanks": "a" + " " * n + "b" + " " * 77 + "c",
        "mixed": "".join(rng.choice(("字", "x", " ", "the", "é", "😀", "0")) for _ in range(n // 2)),
    }


@pytest.mark.parametrize("kind", sorted(samples(10)))
@pytest.mark.parametrize("n", [50, 3000, 9001])
def test_ids_equal_the_library(both, kind, n):
    mine, library = both
    text = samples(n)[kind]
    assert mine.encode([text])[0].tolist() == library.encode(text)


def test_many_units_of_all_lengths(both):
    mine, library = both
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh▁é漢") for _ in range(rng.randrange(1, 60))) for _ in range(30)) for _ in range(60)]
    assert [x.tolist() for x in mine.encode(texts)] == [library.encode(t) for t in texts]


@pytest.mark.parametrize("overlap", [1, 4])
def test_stretches_that_disagree_start_further_back(both, monkeypatch, overlap):
    """With hardly any overlap stretches disagree, and the result is the same."""
    mine, library = both
    monkeypatch.setattr(pieces, "_STRETCH", 40)
    for kind in ("letters", "one letter", "period", "base64"):
        text = samples(1500)[kind]
        fresh = pieces.Encoder(mine.model)
        monkeypatch.setattr(pieces, "_OVERLAP", overlap)
        assert fresh.encode([text])[0].tolist() == library.encode(text)


@pytest.mark.parametrize("kind", ["chinese", "thai", "base64", "letters"])
def test_time_grows_with_the_text(both, kind):
    mine, _ = both
    seconds = []
    for n in (20_000, 160_000):
        text = samples(n)[kind]
        start = time.perf_counter()
        pieces.Encoder(mine.model).encode([text])
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 20 * max(seconds[0], 0.02)
