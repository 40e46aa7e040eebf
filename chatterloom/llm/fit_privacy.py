"""Fits the weights of :mod:`privacy`: ``python -m chatterloom.llm.fit_privacy [TEXTS]``.

The labelled texts are written by the grammar of :mod:`privacy_corpus`; no text of any data
folder is read, and no name, street or town is a feature by itself. ``TEXTS`` (default 50,000)
bounds the sample. At the end precision and recall of each kind are printed for texts of the
other part of the grammar, which shares no frame and no name with the fit.
"""

from __future__ import annotations

import json
import sys
from collections import Counter

from chatterloom.llm import crf
from chatterloom.llm.privacy import WEIGHTS, find, mark, model, tokenize
from chatterloom.llm.privacy_corpus import Writer, template_words

TEXTS, HELD_TEXTS = 50_000, 4_000


def fillers() -> list[str]:
    """Common words that are no names: the vocabulary's words of small letters."""
    ranks = crf.word_ranks()
    words = sorted((r, w) for w, r in ranks.items() if r < 30_000 and w.isalpha() and w.islower() and 4 <= len(w) <= 11)
    return [w.decode() for _, w in words if crf.rarity(w.decode())[1] == "c"]


def gold(spans: list[tuple[int, int, str]], where: list[tuple[int, int]]) -> list[int]:
    """Label of each token, by the stretches of the entities."""
    y = [0] * len(where)
    for s, e, kind in spans:
        for i, (a, _) in enumerate(where):
            if s <= a < e:
                y[i] = crf.LABELS.index(kind)
    return y


def measure(which: str, n: int, seed: int, path: str = WEIGHTS, factor: float = 1.0) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of texts of each kind, a case being a text and a kind in it."""
    made = list(Writer(which, seed, fillers()).texts(n))
    found = find([t for t, _ in made], path, factor)
    true, got, both = Counter(), Counter(), Counter()
    for (_, spans), hits in zip(made, found):
        a, b = {k for *_, k in spans}, {k for k, *_ in hits}
        true.update(a)
        got.update(b)
        both.update(a & b)
    return {k: (both[k] / max(1, got[k]), both[k] / max(1, true[k]), true[k]) for k in crf.LABELS[1:]}


def main(texts: int = TEXTS) -> None:
    docs, marks, ys = [], [], []
    for text, spans in Writer("fit", 1, fillers()).texts(texts):
        d, where = tokenize(text)
        if d:
            docs.append(d)
            marks.append(mark(text, where))
            ys.append(gold(spans, where))
    made = crf.fit(docs, marks, ys, template_words("fit"))
    with open(WEIGHTS, "w", encoding="utf-8") as f:
        json.dump(made, f, ensure_ascii=False, separators=(",", ":"))
    model.cache_clear()
    for kind, (p, r, n) in measure("held", HELD_TEXTS, 2).items():
        print(f"{kind}: precision {p:.3f}, recall {r:.3f}, {n} cases")


if __name__ == "__main__":
    main(*map(int, sys.argv[1:2]))
