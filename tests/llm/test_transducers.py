"""Toxicity's transducers: the composed machine against its parts in turn and
against the clause rules as a plain loop."""
import math
import random
import re

import pandas as pd
import pytest

from parley.llm import toxicity as X
from parley.llm.transducers import ANY, Transducer, compose, determinized

LEXICON = {"idio*": 4.0, "idiot": 5.0, "scum": 5.0, "idiotic*": 6.0, "kill*": 3.0}
VOCABULARY = ["idiot", "idio", "idiotic", "idiotical", "scum", "scums", "kill", "kills", "die", "you", "they", "not",
              "never", "said", "wrote", "the", "x", "ö", ".", "!", '"', "“", "\n", "..", '""']


def texts(n, seed=1):
    r = random.Random(seed)
    return [" ".join(r.choice(VOCABULARY) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def plain_clauses(text):
    """The rules of a clause, read off its words one after another."""
    def symbol(w):
        found = [v for e, v in LEXICON.items() if (w.startswith(e[:-1]) and len(w) > len(e) - 1 if e[-1] == "*" else w == e)]
        return ("I", max(found)) if found else ("T", 1.0) if w in X.THREATS else ("Y", 0.0) if w in X.TARGETS else \
            ("N", 0.0) if w in X.NEGATIONS else ("R", 0.0) if w in X.REPORTS else ("-", 0.0)

    out, words, report, quoted = [], [], False, False
    for token in [*re.findall(r"\w+|[.!?;\n\"“”„«»]", text.lower()), "."]:
        if token in '"“”„«»':
            quoted = not quoted
        elif token not in ".!?;\n":
            words.append(symbol(token))
            report = report or words[-1][0] == "R"
        else:
            hits = [(i, s, w) for i, (s, w) in enumerate(words) if s in "IT"]
            negated = [any(s == "N" for s, _ in words[max(0, i - X.NEGATION_REACH):i]) for i, _, _ in hits]
            free = {s for (_, s, _), n in zip(hits, negated, strict=True) if not n}
            target = "_target" if any(s == "Y" for s, _ in words) else ""
            if words:
                out.append(("clean", 0.0) if not hits else
                           ("reported" if report else ("threat" if "T" in free else "insult") + target if free else "negated",
                            max(w for _, _, w in hits)))
            words, report = [], report and quoted
    return out


def test_grammar_follows_the_rules_of_a_clause():
    g = X.Grammar(LEXICON)
    for text in texts(20_000):
        assert g.clauses(text) == plain_clauses(text), text


def test_composition_equals_the_parts_in_turn():
    parts = [X.lexicon_transducer(LEXICON), X.negation_transducer(), X.report_transducer(), X.matcher_transducer()]
    whole = parts[0]
    for p in parts[1:]:
        whole = compose(whole, p)
    assert len(whole.starts) == 2 and len({s for s in whole.arcs}) > 200
    g = X.Grammar(LEXICON)
    for text in texts(1500, seed=2):
        letters = [(x, 0.0) for t in X.tokens(text) for x in ((t,) if t in X.MARKS else (*t, X.END))]
        turn = letters
        for p in parts:
            turn = p.run(turn)
        assert whole.run(letters) == turn == g.clauses(text), text


def test_a_guess_dies_and_a_deterministic_machine_needs_one_output():
    t = X.report_transducer()
    run = lambda symbols: "".join(s for s, _ in t.run([(x, 0.0) for x in symbols]))
    assert run("I-.") == "I-." and run("IR.I.") == "JR.I." and run('R"I.I".I.') == 'R"J.J".I.'
    two = Transducer()
    two.arc(0, "a", "x", 0.0, 1)
    two.arc(0, "a", "y", 0.0, 2)
    with pytest.raises(ValueError, match="different"):
        determinized(two)
    with pytest.raises(ValueError, match="no path"):
        two.run([("b", 0.0)])


def test_weights_are_those_of_the_strongest_arc():
    t = Transducer()
    t.arc(0, "a", "", 2.0, 1)
    t.arc(0, "a", "", 3.0, 2)
    t.arc(1, ANY, "x", 1.0, 3)
    t.arc(2, ANY, "x", 1.0, 3)
    t.arc(3, "a", "y", 0.5, 3)
    t.final.add(3)
    assert t.run([("a", 0.0), ("b", 0.0), ("a", 0.0)]) == [("x", 3.0), ("y", 0.5)]
    swap = Transducer()
    swap.arc(0, "x", "z", 4.0, 0)
    swap.arc(0, "y", "", 0.0, 0)
    swap.final.add(0)
    assert compose(t, swap).run([("a", 0.0), ("b", 0.0), ("a", 0.0)]) == [("z", 4.0)]


def test_long_words_and_the_word_cache(monkeypatch):
    monkeypatch.setattr(X, "WORD_CACHE", 1000)
    g = X.Grammar(LEXICON)
    for i in range(50):
        assert g.symbol(f"idio{i}") == ("I", 4.0) and len(g._kept) <= 10 + len(X._ENDS | X._QUOTES)  # marks stay
    assert g.symbol("x" * 300_000) == ("-", 0.0)
    assert g.clauses("") == [] and g.clauses("you idiot" + "s" * 100_000) == [("insult_target", 4.0)]


def test_lexicon_asks_for_evidence_not_for_a_share(spark):
    """25 texts of 5,000 toxic ones, none of 20,000 others, are evidence; so is
    the same in a table a hundredth as large; three texts are not."""
    for n in (5000, 50):
        rows = [("", 4 * n, n), ("rare", 0, 25), ("seldom", 0, 3), ("common", 4 * n // 2, n // 2), ("clean", n // 5, 0)]
        df = spark.createDataFrame(pd.DataFrame(
            [(e, c, t, 0, 0) for e, c, t in rows], columns=["entry", "n00", "n01", "n10", "n11"]))
        got = X.lexicon(df, (0,))
        assert set(got) == {"rare"}
        assert math.isclose(got["rare"], math.log(25.5 / (n + 1)) - math.log(0.5 / (4 * n + 1)), rel_tol=1e-9)
    assert X.lexicon(spark.createDataFrame(pd.DataFrame([("", 5, 0, 0, 0)], columns=["entry", "n00", "n01", "n10", "n11"])), (0,)) == {}


def test_training_without_labels_or_documents(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "a fool"), (2, None)], "doc_id long, text string")
    for d, lab in ((docs, labels), (no_docs, spark.createDataFrame([(1, 1), (2, 0)], labels.schema))):
        g = X.train(d, lab)
        assert {round(r["score"], 6) for r in X.score_toxicity(docs, g).collect()} == {0.5}
