"""The rule automaton by hand and against a matcher that tries everything."""

import random

import pytest

from optiq.operators import grammar as G

TEXTS = [  # text, (rule, words)
    ("He should of gone to the the store.", [("modal_of", "should of"), ("doubled_word", "the the")]),
    ("I would not of course say that that is an cat.", [("modal_of", "would not of"), ("an_before_consonant", "an cat")]),
    ("You must of course go.", [("modal_of", "must of")]),
    ("A apple, a one, an hour.", [("a_before_vowel", "A apple")]),
    ("two really nice person", []),
    ("two really person and many child", [("singular_after_number", "two really person"), ("singular_after_number", "many child")]),
    ("This is more better then that.", [("double_comparative", "more better"), ("then_for_than", "better then")]),
    ("Wait,;: he left. then she did n't went.", [("marks_in_a_row", ", ; :"), ("did_past", "did n't went")]),
    ("It ended ! then it rained", [("lower_after_stop", "! then")]),
    ("very very very very good", [("doubled_word", "very very"), ("doubled_word", "very very"), ("very_run", "very very very very")]),
    ("Nothing wrong here.", []), ("", []), (None, []),
]


def test_rules_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "id int, text string")
    got = {i: [] for i in range(len(TEXTS))}
    for r in sorted(G.grammar_spans(df, ["id"]).collect(), key=lambda r: (r.id, r.start)):
        assert len(r.words.split()) == r.n_tokens
        got[r.id].append((r.rule, r.words))
    for i, (text, want) in enumerate(TEXTS):
        # pairs that are exceptions as a whole are no matches
        want = [w for w in want if w != ("doubled_word", "very very")]
        assert sorted(got[i]) == sorted(want), text
    scores = {r.id: r for r in G.grammar_scores(df, ["id"]).collect()}
    assert scores[0].n_faults == 2 and scores[0].inverse == 1 / 3 and scores[0].ratio == 1 - 2 / 9
    assert scores[11].ratio == scores[12].ratio == 1.0 and scores[12].n_faults == 0


def ends(elements, p, tokens, i):
    """All ends of a match of elements[p:] at token i."""
    if p == len(elements):
        yield i
        return
    e = elements[p]
    if e.optional:
        yield from ends(elements, p + 1, tokens, i)
    j = i
    while j < len(tokens) and G.fits(e, tokens[j], tokens[j - 1] if j else None):
        j += 1
        yield from ends(elements, p + 1, tokens, j)
        if not e.repeats:
            break


def brute(rules, tokens):
    out = []
    for n, rule in enumerate(rules):
        elements = [G.element(x) for x in rule.pattern.split()]
        leftmost = {}
        for i in range(len(tokens)):
            for end in ends(elements, 0, tokens, i):
                leftmost[end] = min(i, leftmost.get(end, i))
        reach = 0
        for start, end in sorted(((s, e) for e, s in leftmost.items()), key=lambda x: (x[0], -x[1])):
            if start >= reach and " ".join(tokens[start:end]).lower() not in rule.exceptions:
                out.append((n, start, end))
                reach = end
    return sorted(out, key=lambda m: (m[1], m[0]))


def test_automaton_equals_trying_everything():
    rng = random.Random(3)
    parts = ["a", "b", "a|b", "c", "@word", "@same", "@end", "@lower", "A"]
    for _ in range(1500):
        rules = []
        for k in range(rng.randint(1, 4)):
            pattern = [rng.choice(parts) + rng.choice(["", "", "", "?", "+"]) for _ in range(rng.randint(1, 4))]
            if all(x.endswith("?") for x in pattern):
                pattern.append("c")
            rules.append(G.Rule(f"r{k}", " ".join(pattern), tuple(rng.sample(["a b", "a a", "b c", "c"], rng.randint(0, 2)))))
        tokens = [rng.choice(["a", "b", "c", "A", "B", "."]) for _ in range(rng.randint(0, 14))]
        assert G.Automaton(rules).matches(tokens) == brute(rules, tokens), (rules, tokens)


def test_the_table_equals_trying_everything():
    rng = random.Random(4)
    words = sorted({w for r in G.RULES for x in r.pattern.split() for w in G.element(x).words}) + \
        [".", ",", "!", "apple", "Cat", "quickly", "better", "the", "3.5"]
    automaton = G.Automaton(G.RULES)
    for _ in range(400):
        tokens = [rng.choice(words) for _ in range(60)]
        assert automaton.matches(tokens) == brute(G.RULES, tokens)


def test_a_long_run_is_linear():
    tokens = ["very"] * 200_000
    assert G.Automaton(G.RULES).matches(tokens)[-1][2] == 200_000


def test_broken_rules():
    for pattern in ("@unknown", "a? b?"):
        with pytest.raises(ValueError):
            G.Automaton([G.Rule("x", pattern)])


def test_matches_begin_only_where_neighbours_fit():
    """The places that a batch's neighbours leave give the matches of all places, at a
    small part of the places."""
    import pyarrow as pa
    rng, automaton = random.Random(3), G.Automaton(G.RULES)
    words = "very had a one apple of should not must quickly to two many child then better , . ! x The the it".split()
    lists = [[rng.choice(words) for _ in range(rng.randint(0, 25))] for _ in range(800)] + [[], ["plain"] + ["alpha", "beta"] * 50]
    want = [(i, automaton.matches(x)) for i, x in enumerate(lists) if automaton.matches(x)]
    tokens = pa.array([["cut"], *lists], pa.list_(pa.string())).slice(1)
    assert [(i, m) for i, own, m in automaton.batch_matches(tokens) if own == lists[i]] == want
    at = automaton.live(pa.array([lists[-1]], pa.list_(pa.string())))[0]
    assert len(at) == 0 and list(automaton.batch_matches(pa.array([[], None], pa.list_(pa.string())))) == []
