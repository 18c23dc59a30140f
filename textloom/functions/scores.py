"""Deterministic scorers: each gives a component, and ledgers add up to a reward."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import text as X

# Weights of the grammar reward; length multiplies.
GRAMMAR_WEIGHTS = {"exact": 0.4, "char": 0.2, "pattern": 0.15, "affix": 0.1}
# Weights of the five-part reward.
FIVE_PART_WEIGHTS = {"semantic": 0.35, "char": 0.25, "pattern": 0.20, "affix": 0.15, "length": 0.05}
# Weights of the question-answer reward.
QA_WEIGHTS = {"exact": 0.20, "terms": 0.30, "char": 0.25, "keywords": 0.15, "length": 0.10}
#: Not applicable; left out of averages.
NOT_APPLICABLE = -1.0


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def f1(hits: Column, predicted: Column, gold: Column) -> Column:
    """2pr / (p + r) of counts; 0 where nothing is shared."""
    return F.when(hits > 0, 2.0 * hits / (predicted + gold)).otherwise(0.0)


def set_f1(pred: Column, gold: Column) -> Column:
    both = F.struct(pred.alias("p"), gold.alias("g"))
    return X.let(both, lambda v: X.let(F.size(F.array_intersect(v["p"], v["g"])), lambda n: f1(n, F.size(v["p"]), F.size(v["g"]))))


def token_f1(answer: Column, accepted: Column) -> Column:
    """The best F1 of word sets over the accepted answers."""
    scores = lambda own: F.transform(accepted, lambda a: set_f1(own, X.gloss_tokens(a)))
    return X.let(X.gloss_tokens(answer), lambda own: F.coalesce(F.array_max(scores(own)), F.lit(0.0)))


def bigrams(c: Column) -> Column:
    # over characters: a substring of a long text is found by walking to it
    pairs = lambda xs: F.zip_with(F.slice(xs, F.lit(1), F.size(xs) - 1), F.slice(xs, F.lit(2), F.size(xs)), lambda a, b: F.concat(a, b))
    return X.let(F.split(c, ""), lambda xs: F.when(F.length(c) >= 2, F.array_distinct(pairs(xs))).otherwise(F.array().cast("array<string>")))


def bigram_dice(a: Column, b: Column) -> Column:
    return set_f1(bigrams(a), bigrams(b))


def _count(c: Column, ch: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, ch, F.lit("")))


def multiset_f1(pred: Column, gold: Column) -> Column:
    """F1 of the characters of two strings, each as often as it occurs."""
    distinct = lambda g: F.filter(F.array_distinct(F.split(g, "")), lambda x: x != "")
    hits = lambda v: F.aggregate(distinct(v["g"]), F.lit(0), lambda a, ch: a + F.least(_count(v["p"], ch), _count(v["g"], ch)))
    both = F.struct(pred.alias("p"), gold.alias("g"))
    return X.let(both, lambda v: X.let(hits(v), lambda n: f1(n, F.length(v["p"]), F.length(v["g"]))))


def char_f1(pred: Column, gold: Column) -> Column:
    """Character F1 without white space and case."""
    bare = lambda c: F.translate(X.normalize_ws(c), " ", "")
    return multiset_f1(bare(pred), bare(gold))


def special_char_f1(span: Column, gold: Column, expected: Column | None = None) -> Column:
    """F1 of the marked characters, those of the gold or, if a row names some, the expected ones.

    -1 if there are none to find; an empty answer gives 0.
    """
    only = lambda c: F.array_join(F.regexp_extract_all(X.text(c), F.lit(f"([{X.EXPECTED_LETTERS}])"), 1), "")
    wanted = only(gold)
    if expected is not None:
        wanted = F.when(F.size(F.coalesce(expected, F.array().cast("array<string>"))) > 0, F.array_join(expected, "")).otherwise(wanted)
    found = lambda w: F.when(w == "", NOT_APPLICABLE).when(X.strip_ws(span) == "", 0.0).otherwise(multiset_f1(only(span), w))
    return X.let(wanted, found)


def exact_match(span: Column, gold: Column) -> Column:
    a, b = X.normalize_ws(span), X.normalize_ws(gold)
    return _flag((a != "") & (a == b))


def word_overlap(answer: Column, gold: Column) -> Column:
    """Share of the gold's distinct words that the answer has."""
    g, a = (F.array_distinct(F.filter(F.split(X.normalize_ws(c), " "), lambda t: t != "")) for c in (gold, answer))
    return X.let(g, lambda g: F.when(F.size(g) > 0, F.size(F.array_intersect(a, g)) / F.size(g)).otherwise(0.0))


def length_guard(span: Column, longest: Column, ratio: float = 3.0, free: int = 24) -> Column:
    """1 up to ``ratio`` times the longest gold or ``free`` characters, then shrinking."""
    times = F.length(span) / F.greatest(longest, F.lit(1))
    return F.when((times <= ratio) | (F.length(span) <= free), 1.0).otherwise(ratio / times)


def length_penalty(answer: Column, gold: Column, ratio: float = 3.0) -> Column:
    """0 for an empty answer, 1 up to ``ratio`` times the gold, then shrinking."""
    n = F.length(F.trim(X.text(answer)))
    times = n / F.greatest(F.length(F.trim(X.text(gold))), F.lit(1))
    return F.when(n == 0, 0.0).when(times <= ratio, 1.0).otherwise(ratio / times)


def length_smooth(answer: Column, gold: Column, low: float = 0.35, high: float = 2.5) -> Column:
    """1 between two ratios, then falling with the log distance to the nearer one."""
    n = F.length(F.trim(X.text(answer)))
    times = n / F.greatest(F.length(X.text(gold)), F.lit(1))
    off = F.least(F.abs(F.ln(F.greatest(times, F.lit(1e-6)) / low)), F.abs(F.ln(F.greatest(times, F.lit(1e-6)) / high)))
    return F.when(n == 0, 0.0).when(times.between(low, high), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off / 2))


def affix_score(span: Column, gold: Column, affixes: Column) -> Column:
    """Share of the required affixes whose gold token the answer has; 0 if none is required."""
    hit = lambda said, a: F.arrays_overlap(said, F.transform(X.affix_tokens(gold, a), lambda t: F.lower(t)))
    hits = X.let(F.split(X.normalize_ws(span), " "), lambda said: F.size(F.filter(affixes, lambda a: F.coalesce(hit(said, a), F.lit(False)))))
    return F.when(F.coalesce(F.size(affixes), F.lit(0)) > 0, hits / F.size(affixes)).otherwise(0.0)


def literal_pattern(span: Column, pattern: Column) -> Column:
    """Whether the answer holds the pattern, or what follows its colon, as text."""
    said, whole = X.normalize_ws(span), X.normalize_ws(pattern)
    part = F.when(F.contains(X.text(pattern), F.lit(":")), X.normalize_ws(F.regexp_replace(X.text(pattern), r"^[^:]*:", ""))).otherwise(F.lit(""))
    return _flag(((whole != "") & F.contains(said, whole)) | ((part != "") & F.contains(said, part)))


def difficulty_weight(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("intermediate")))
    return reduce(lambda a, kv: F.when(low == kv[0], kv[1]).otherwise(a), X.DIFFICULTY_WEIGHTS.items(), F.lit(1.0))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * parts[k] for k, w in weights.items()])


def grammar_ledger(raw: Column, gold: Column, affixes: Column, pattern: Column, difficulty: Column, letters: Column | None = None) -> dict[str, Column]:
    """Components, contributions and the reward, of which the rest is rebuilt."""
    span = X.extract_final(raw)
    parts = {"exact": exact_match(span, gold), "char": char_f1(span, gold), "pattern": pattern, "affix": affix_score(span, gold, affixes)}
    length = length_penalty(raw, gold)
    pre = weighted(parts, GRAMMAR_WEIGHTS)
    out = {f"{k}_raw": v for k, v in parts.items()}
    out |= {f"contrib_{k}": GRAMMAR_WEIGHTS[k] * v for k, v in parts.items()}
    out |= {"special_char_raw": special_char_f1(span, gold, letters), "length_penalty": length, "composite_pre": pre, "difficulty_multiplier": difficulty_weight(difficulty)}
    return out | {"reward": pre * length, "passed": _flag(parts["exact"] == 1.0)}


def syllabify_ledger(span: Column, gold: Column) -> dict[str, Column]:
    cand = F.translate(X.canon(span), " ", "")
    letters = _flag(X.plain(cand) == X.plain(gold))
    exact = _flag(cand == gold)
    parts, gparts = F.split(cand, "-"), F.split(gold, "-")
    bare = lambda ps: F.transform(ps, lambda p: F.translate(p, "'", ""))
    cuts, gcuts = X.syllable_cuts(bare(parts)), X.syllable_cuts(bare(gparts))
    boundary = F.when((F.size(cuts) == 0) & (F.size(gcuts) == 0), 1.0).otherwise(set_f1(cuts, gcuts))
    accents = lambda ps: F.filter(F.transform(ps, lambda p, i: F.when(F.contains(p, F.lit("'")), i)), lambda i: i.isNotNull())
    end = lambda ps, i: F.length(F.array_join(F.slice(bare(ps), F.lit(1), i + 1), ""))
    where = F.coalesce(F.get(accents(gparts), 0), F.lit(0))
    stress = _flag((F.size(accents(parts)) == 1) & (end(parts, F.coalesce(F.get(accents(parts), 0), F.lit(0))) == end(gparts, where)))
    raw = F.when(letters == 0, 0.0).when(exact == 1, 1.0).otherwise(0.6 * boundary + 0.2 * stress)
    shown = lambda c: F.when(letters == 1, c).otherwise(0.0)
    return {"exact": exact, "letters_ok": letters, "boundary_f1": shown(boundary), "stress_ok": shown(stress), "raw": raw}


def set_ledger(span: Column, accepted: Column) -> dict[str, Column]:
    pred, gold = X.forms_set(span), F.array_distinct(F.transform(accepted, X.plain))
    near = lambda xs: F.array_distinct(F.transform(xs, X.loose))
    same = (F.size(pred) == F.size(gold)) & (F.size(F.array_intersect(pred, gold)) == F.size(gold))
    return {"exact": _flag(same), "set_f1": set_f1(pred, gold), "loose_f1": set_f1(near(pred), near(gold)), "raw": set_f1(pred, gold)}


def choice_ledger(span: Column, accepted: Column) -> dict[str, Column]:
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")
    hit = _flag(F.array_contains(F.transform(accepted, bare), bare(span)))
    return {"exact": hit, "raw": hit}


def form_ledger(span: Column, accepted: Column, arm: Column) -> dict[str, Column]:
    """A form asked for in English: 1 if accepted, 0.7 for a nasal's difference, else a share of the overlap."""
    cand = F.translate(F.regexp_replace(X.plain(span), r"^[ .]+|[ .]+$", ""), " ", "")
    gold = F.transform(accepted, lambda a: F.translate(X.plain(a), " ", ""))
    exact, near = F.array_contains(gold, cand), F.array_contains(F.transform(gold, X.loose), X.loose(cand))
    dice = F.coalesce(F.array_max(F.transform(gold, lambda g: bigram_dice(cand, g))), F.lit(0.0))
    rest = F.when(arm == "gated", 0.0).otherwise(0.25 * dice)
    return {"exact": _flag(exact), "loose_match": _flag(near), "char_dice": dice, "raw": F.when(exact, 1.0).when(near, 0.7).otherwise(rest)}


def gloss_ledger(span: Column, accepted: Column) -> dict[str, Column]:
    best = token_f1(span, accepted)
    return {"exact": _flag(best == 1.0), "token_f1": best, "raw": best}


#: Scorers by task: (span, gold, accepted, arm) -> ledger. Add an entry to add a task.
SCORERS: dict[str, Callable[[Column, Column, Column, Column], dict[str, Column]]] = {
    "syllabify": lambda s, g, a, arm: syllabify_ledger(s, g),
    "inflect": lambda s, g, a, arm: set_ledger(s, a),
    "root": lambda s, g, a, arm: set_ledger(s, a),
    "pos": lambda s, g, a, arm: choice_ledger(s, a),
    "en_to_dak": lambda s, g, a, arm: form_ledger(s, a, arm),
    "gloss": lambda s, g, a, arm: gloss_ledger(s, a),
    "lookup_gloss": lambda s, g, a, arm: gloss_ledger(s, a),
    "lookup_root_gloss": lambda s, g, a, arm: gloss_ledger(s, a),
}


# The arms of an experiment, and the version of the rules that each is scored by.
SCORER_VERSIONS = {"baseline": "2026-11-10.2", "gated": "2026-11-13-gated.1"}


def scorer_version(arm: Column) -> Column:
    """The version of an arm's rules; an unknown arm is scored as the first."""
    known = F.create_map(*[F.lit(x) for kv in SCORER_VERSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, arm), F.lit(SCORER_VERSIONS["baseline"]))


def every_arm() -> Column:
    """A row for each arm, by an explode."""
    return F.explode(F.array(*map(F.lit, SCORER_VERSIONS)))


def score(task: Column, completion: Column, gold: Column, accepted: Column, arm: Column | None = None) -> Column:
    """Struct (reward, exact, raw, parsed, answer_len, length_mult, parts) of one completion, by its task."""
    arm = F.lit("baseline") if arm is None else arm

    def of(answer: Column) -> Column:
        span = answer["span"]
        ledgers = {kind: scorer(span, gold, accepted, arm) for kind, scorer in SCORERS.items()}
        names = sorted({k for led in ledgers.values() for k in led})
        null = F.lit(None).cast("double")
        shape = lambda led: F.struct(*[led.get(n, null).cast("double").alias(n) for n in names])
        # one ledger is computed, that of the row's task
        chosen = shape({})
        for kind, led in ledgers.items():
            chosen = F.when(task == kind, shape(led)).otherwise(chosen)
        chosen = F.when(span == "", shape({"exact": F.lit(0.0), "raw": F.lit(0.0)})).otherwise(chosen)
        longest = F.greatest(F.length(X.text(gold)), F.coalesce(F.array_max(F.transform(accepted, lambda a: F.length(a))), F.lit(0)))
        guard = length_guard(span, longest)
        done = lambda led: F.struct(
            (led["raw"] * guard).alias("reward"),
            *[led[n].alias(n) for n in names],
            _flag(answer["parsed"]).alias("parse_ok"),
            F.length(span).cast("double").alias("answer_len"),
            guard.alias("length_mult"),
        )
        return X.let(chosen, done)

    return X.let(X.extract_answer(completion), of)


def qa_parts(answer: Column, gold: Column) -> dict[str, Column]:
    """Exactness, terms, characters, keywords and length of a free answer."""
    share = lambda said: lambda terms: F.when(F.size(terms) == 0, 1.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(said, X.compact(t)))) / F.size(terms))
    shared = lambda keys: F.when(F.size(keys) == 0, 1.0).otherwise(F.size(F.array_intersect(keys, X.word_set(answer))) / F.size(keys))
    return {
        "exact": _flag(X.normalize_quotes(answer) == X.normalize_quotes(gold)),
        "terms": X.let(X.compact(answer), lambda said: X.let(X.marked_terms(gold), share(said))),
        "char": multiset_f1(X.compact(answer), X.compact(gold)),
        "keywords": X.let(X.top_keywords(gold), shared),
        "length": length_smooth(answer, gold),
    }


def qa_score(answer: Column, gold: Column) -> Column:
    return weighted(qa_parts(answer, gold), QA_WEIGHTS)


def mcq_score(answer: Column, correct: Column, lines: int = 3) -> Column:
    """0.9 for the letter and 0.1 if what was parsed, a letter or nothing, has no more than so many lines that aren't blank."""
    return X.let(X.extract_option(answer), lambda said: 0.9 * _flag(said == F.upper(F.trim(correct))) + 0.1 * _flag(F.size(F.filter(F.split(said, "\n"), lambda x: F.trim(x) != "")) <= lines))


def shown_affixes(answer: Column, affixes: Column) -> Column:
    """Share of the affixes that stand in the answer where their hyphen says: at a word's end, at its start, or anywhere; 1 if none is asked for."""
    bare = lambda a: F.regexp_replace(a, "^-+|-+$", "")
    quoted = lambda a: F.concat(F.lit(r"\Q"), F.replace(bare(a), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    ends, starts = lambda a: a.startswith("-") & ~a.endswith("-"), lambda a: a.endswith("-") & ~a.startswith("-")
    word = r"[\p{L}\p{N}_]"
    hit = lambda a: (
        F.when(ends(a), F.rlike(X.text(answer), F.concat(F.lit(word + "+"), quoted(a), F.lit(f"(?!{word})"))))
        .when(starts(a), F.rlike(X.text(answer), F.concat(F.lit(f"(?<!{word})"), quoted(a), F.lit(word + "+"))))
        .otherwise(F.contains(X.text(answer), bare(a)))
    )
    return _share(F.filter(affixes, hit), affixes)


def _share(found: Column, asked: Column) -> Column:
    return F.when(F.coalesce(F.size(asked), F.lit(0)) > 0, F.size(found) / F.size(asked)).otherwise(1.0)


def shown_letters(answer: Column, letters: Column) -> Column:
    """Share of the expected marked letters that the answer has; 1 if none is expected."""
    wanted = F.array_distinct(letters)
    return _share(F.array_intersect(wanted, F.regexp_extract_all(X.text(answer), F.lit(f"([{X.EXPECTED_LETTERS}])"), 1)), wanted)


def _words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""))


def meaning(answer: Column, gold: Column) -> Column:
    """1 if the answer holds the gold, else the share of the gold's distinct words; 1 if it has none."""
    a, g = X.normalize_ws(answer), X.normalize_ws(gold)
    share = lambda v: F.size(F.array_intersect(_words_of(v["a"]), _words_of(v["g"]))) / F.size(_words_of(v["g"]))
    return X.let(F.struct(a.alias("a"), g.alias("g")), lambda v: F.when((v["g"] == "") | F.contains(v["a"], v["g"]), 1.0).otherwise(share(v)))


def hinted(answer: Column, pattern: Column, found: Column, hints: Column) -> Column:
    """1 if the pattern was found, else the share of hints that the answer has; 1 where nothing is asked for."""
    some = F.coalesce(F.size(hints), F.lit(0)) > 0
    covered = F.size(F.filter(hints, lambda h: F.contains(F.lower(X.text(answer)), F.lower(h)))) / F.size(hints)
    return F.when(found == 1.0, 1.0).when(some, covered).when(X.text(pattern) == "", 1.0).otherwise(0.0)


def length_quality(answer: Column, gold: Column, ratio: float = 8.0, least: int = 2) -> Column:
    """0 for fewer than two characters, 1 up to ``ratio`` times the gold, then shrinking."""
    n, g = F.length(X.strip_ws(answer)), F.length(X.strip_ws(gold))
    return F.when(n < least, 0.0).when((g > 0) & (n > ratio * g), ratio * g / n).otherwise(1.0)


def five_part_score(answer: Column, gold: Column, affixes: Column, pattern: Column, found: Column, hints: Column, difficulty: Column) -> Column:
    """Meaning, characters, pattern (``found``: 1 or 0, of `udfs.pattern_score`) or hints, affixes and length, times difficulty."""
    parts = {"semantic": meaning(answer, gold), "char": char_f1(answer, gold), "pattern": hinted(answer, pattern, found, hints), "affix": shown_affixes(answer, affixes), "length": length_quality(answer, gold)}
    return weighted(parts, FIVE_PART_WEIGHTS) * difficulty_weight(F.coalesce(difficulty, F.lit("medium")))


# Weights of marked letters, affixes and meaning by task; any other task has the last.
ADAPTIVE_WEIGHTS = {
    "morphology": (0.4, 0.4, 0.2),
    "word_translation": (0.3, 0.0, 0.7),
    "sentence_translation": (0.3, 0.0, 0.7),
    "reverse_translation": (0.5, 0.0, 0.5),
    "": (0.33, 0.33, 0.34),
}


def adaptive_score(task: Column, answer: Column, gold: Column, letters: Column, affixes: Column, difficulty: Column) -> Column:
    """Expected letters, affixes and meaning, weighted by task, times difficulty.

    The meaning is 1 if the answer holds the gold; else the share of the gold's
    words in a translation of a word or sentence, and 0 in other tasks.
    """
    a, g = (F.lower(X.strip_ws(c)) for c in (answer, gold))
    words = X.let(_words_of(g), lambda ws: F.when(F.size(ws) > 0, F.size(F.array_intersect(ws, _words_of(a))) / F.size(ws)).otherwise(0.0))
    held = F.when((g != "") & F.contains(a, g), 1.0).when(task.isin("word_translation", "sentence_translation"), words).otherwise(0.0)
    both = F.struct(shown_letters(answer, letters).alias("c"), shown_affixes(answer, affixes).alias("x"), held.alias("m"))

    def base(v: Column) -> Column:
        by = {kind: w[0] * v["c"] + w[1] * v["x"] + w[2] * v["m"] for kind, w in ADAPTIVE_WEIGHTS.items()}
        return reduce(lambda rest, kind: F.when(task == kind, by[kind]).otherwise(rest), [k for k in by if k], by[""])

    return X.let(both, base) * difficulty_weight(difficulty)


def binary_rubric(score_: Column, threshold: float = 0.95) -> Column:
    return _flag(score_ >= threshold)


def curriculum_rubric(score_: Column, level: Column, student: Column) -> Column:
    """A tenth on top for each level above the student's."""
    return score_ + 0.1 * F.greatest(level - student, F.lit(0))


def single_turn_check(answer: Column, gold: Column, letters: Column, affixes: Column) -> Column:
    """Equal but for case, or more than nine in ten of the expected letters and of the affixes, wherever they stand."""
    bare = lambda a: F.regexp_replace(a, "^-+|-+$", "")
    same = F.lower(X.strip_ws(answer)) == F.lower(X.strip_ws(gold))
    distinct = F.array_intersect(letters, F.regexp_extract_all(X.text(answer), F.lit(f"([{X.EXPECTED_LETTERS}])"), 1))
    held = _share(F.filter(affixes, lambda a: F.contains(X.text(answer), bare(a))), affixes)
    return same | ((_share(distinct, letters) > 0.9) & (held > 0.9))
