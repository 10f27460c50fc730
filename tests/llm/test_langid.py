import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tremorframe.llm import langid as li

SYLLABLES = {"en": "th er on an re he in ed nd", "fr": "é le ou eau ion tre ç qui", "de": "sch ei ung ü ch ie ß zu"}


def rows(n=400):
    r = random.Random(9)
    out = []
    for k in range(n):
        lang = r.choice(list(SYLLABLES))
        s = SYLLABLES[lang].split()
        out.append((k, " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(r.choice([2, 8, 60]))), lang))
    return out


def plain(text_by_lang, lang, gram):
    """Interpolated Kneser-Ney from its definition, with the discounts that the model estimates."""
    grams = Counter()
    for t in text_by_lang[lang]:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            p = " " * (li.ORDER - 1) + w + " "
            grams.update(p[i : i + li.ORDER] for i in range(len(p) - li.ORDER + 1))
    tables = {li.ORDER: grams}
    for k in range(li.ORDER - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    letters = {g[-1] for lang_ in text_by_lang for t in text_by_lang[lang_] for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() for g in [*w, " "]}

    def p(g):
        if not g:
            return 1 / (len(letters) + 1)
        t = tables[len(g)]
        n1, n2 = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)
        same = {x: v for x, v in t.items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        return max(t.get(g, 0) - d, 0) / sum(same.values()) + d * len(same) / sum(same.values()) * p(g[1:])

    return p(gram)


def test_model_is_kneser_ney():
    texts = {k: [t for _, t, lang in rows(60) if lang == k] for k in SYLLABLES}
    names = sorted(texts)
    tables = [np.unique(li.windows(pa.array(" ".join(texts[k]).split()))[0], axis=0, return_counts=True) for k in names]
    model = li.Languages.fit(names, tables)
    for g in ["   t", "  th", " the", "hee ", "schü", "eau ", "zzzz", "éle ", "tion", " xe "]:
        got = np.exp(model.log_p(np.array([[ord(c) for c in g]])))[0]
        assert np.allclose(got, [plain(texts, k, g) for k in names], rtol=1e-9)


def test_held_out_accuracy(spark):
    data = rows() + [(2001, None, "en"), (2002, "123 !?", "fr"), (2003, "", None), (None, "the", "en"), (2004, "then therein", None), (2004, "schung üß", "de"), (2005, "then" * 50000, "en")]
    got = li.language_id(spark.createDataFrame([(*d, 0.1) for d in data], "doc_id long, text string, lang string, score double")).collect()
    assert len(got) == len(data)
    truth = {d: lang for d, _, lang in rows()}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert len(held) > 40 and np.mean([g.lang_pred == truth[g.doc_id] for g in held]) > 0.97
    assert {(g.doc_id, g.lang_pred, g.score) for g in got if g.doc_id in (2001, 2002, 2003)} == {(2001, "und", 0.0), (2002, "und", 0.0), (2003, "und", 0.0)}
    assert sorted(g.lang_pred for g in got if g.doc_id == 2004) == ["de", "en"] and all(0 <= g.score <= 1 for g in got)


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert li.language_id(spark.createDataFrame([], schema)).collect() == []
    (r,) = li.language_id(spark.createDataFrame([(1, "some text", None)], schema)).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)
