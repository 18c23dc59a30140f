"""Text functions: Column in, Column out, all built-in expressions.

Functions that need a Unicode normal form or a regular expression taken from
data are in `textloom.functions.udfs`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Printed variants of one glyph, and the glyph they stand for.
GLYPH_VARIANTS = {
    "š": "ś", "ṡ": "ś", "ș": "ś",
    "ž": "ź", "ż": "ź",
    "η": "ŋ", "ƞ": "ŋ", "ṅ": "ŋ", "ń": "ŋ", "ņ": "ŋ",
    "ǧ": "ġ", "ğ": "ġ", "ǵ": "ġ",
    "ȟ": "ḣ", "ħ": "ḣ",
    "č": "ć", "ċ": "ć", "é": "ć",
    "ţ": "ṭ", "ț": "ṭ", "ṫ": "ṭ",
    "ķ": "ḳ",
}
# The closed alphabet and the marks that stand for an accent.
ALPHABET = "abcdeghikmnopstuwyzćġḣŋśźṭḳṗ"
ACCENTS = "'’ʹ´ˊ`′"
# Letters of one-to-one folding.
FOLDED = {"ŋ": "n", "ġ": "g", "ḣ": "h", "ś": "s", "ź": "z", "ć": "c", "ṭ": "t", "ḳ": "k", "ṗ": "p"}
# Function words by which a form is taken for English.
ENGLISH_HINTS = "the to of and or as is he she it they i we you with for not one that this see from in on a an be by at".split()
# Words that don't count in a gloss.
GLOSS_STOP = "a an the to of as or and in on for with by be is it one any which that at from".split()
# Abbreviations that are spelt in two ways.
POS_ALIASES = {"v.a.": "v. a.", "v.n.": "v. n.", "inj.": "intj.", "interj.": "intj."}
# The parts of speech that tasks ask for.
POS_CLOSED = ["n.", "v. a.", "v. n.", "v.", "adv.", "adj.", "cont.", "v. red.", "part.", "v. pos.", "v. reflex.", "pron.", "prep.", "intj.", "conj.", "num. adj."]
# Golds that were never filled in.
PLACEHOLDERS = ["[TO BE GENERATED", "[explanation]", "[incorrect form]", "[apply first affix]", "[with all affixes applied]"]
# Function words, terms and phrases of English metalanguage.
META_FUNCTION = "the a an of to and or in on for with that this is are was be as by from it word meaning used when which their they".split()
META_TERMS = "agreement antecedent article circumfix conjunction demonstrative infix interjection morphology orthography particle phonology prefix preposition pronoun suffix syntax tense".split()
META_PHRASES = ["end village", "marsh village", "village at the end", "village of the prairie", "second variety", "active transitive verbs", "aorist tense"]
META_NOUNS = "village tense verbs variety".split()
META_GLOSS = "word verb noun tense prefix suffix particle grammatical sentence pronoun adjective adverb conjunction syntax morphology phonology plural singular animate inanimate orthograph".split()
# Words that don't count when a free answer is compared.
QA_STOP = [
    "the", "and", "that", "with", "from", "this", "they", "their", "there",
    "would", "could", "should", "which", "what", "when", "where", "using",
    "into", "about", "also", "because", "within", "while", "your", "you",
    "are", "for", "of", "to", "in", "on", "or", "is", "be", "a", "an", "it",
    "as", "by", "its", "not", "than", "then", "these", "those", "has", "have",
]
# The letters that mark a term of a free answer.
QA_LETTERS = "ćšŋḣṡǧáéíóúķśṅźėčžʼ’"
# The letters by which a headword is taken for a transcribed form.
ORTHOGRAPHIC_MARKERS = "áâäéíóúǫȟŋṡšžčḣĺǧṫų"
# The letters that a task may expect.
EXPECTED_LETTERS = "ćšŋḣṡáéíóúķśṅźėčžʼ"
#: How much a task of a difficulty counts.
DIFFICULTY_WEIGHTS = {"basic": 1.0, "easy": 1.0, "intermediate": 1.2, "medium": 1.2, "advanced": 1.5, "hard": 1.5, "expert": 2.0}

_WORD = r"[\p{L}\p{N}_]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Columns are expressions, so one that is used several times is computed
    several times, and once per element inside a lambda; a lambda's variable
    is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text(c: Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def first_truthy(*cols: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in cols])


def collapse(c: Column) -> Column:
    """Trim; runs of white space are one blank."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def strip_ws(c: Column) -> Column:
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def normalize_ws(c: Column) -> Column:
    return collapse(F.lower(text(c)))


def canon(c: Column) -> Column:
    """Lower case, glyph variants mapped, accents unified, white space collapsed.

    Input that may not be composed goes through `udfs.nfc` first.
    """
    mapped = F.translate(F.lower(text(c)), "".join(GLYPH_VARIANTS), "".join(GLYPH_VARIANTS.values()))
    return collapse(F.translate(mapped, ACCENTS, "'" * len(ACCENTS)))


def plain(c: Column) -> Column:
    """Canonical form without hyphens and accents."""
    return F.translate(canon(c), "-'", "")


def loose(c: Column) -> Column:
    """Plain form in which the nasal and n are one letter and blanks don't count."""
    return F.translate(plain(c), "ŋ ", "n")


def fold_glyphs(c: Column) -> Column:
    return F.translate(text(c), "".join(FOLDED), "".join(FOLDED.values()))


def bad_chars(c: Column) -> Column:
    """Distinct characters outside the alphabet, sorted."""
    rest = F.translate(plain(c), ALPHABET + " ", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda x: x != "")))


def is_suspect(c: Column) -> Column:
    return F.translate(plain(c), ALPHABET + " ", "") != ""


def _strip(c: Column, chars: str) -> Column:
    quoted = "".join("\\" + x for x in chars)
    return F.regexp_replace(F.regexp_replace(c, f"^[{quoted}]+", ""), f"[{quoted}]+$", "")


def clean_form(c: Column) -> Column:
    """Canonical form, or null if it is empty, long, suspect, or looks English."""
    form = _strip(canon(c), " .,;:()[]")
    hint = form.rlike(r"\b(" + "|".join(ENGLISH_HINTS) + r")\b")
    return F.when((form != "") & (F.length(form) <= 60) & ~is_suspect(form) & ~hint, form)


def split_refs(c: Column) -> Column:
    """References of a free-text list: plain forms without blanks or suspects."""
    parts = F.transform(F.split(text(c), r"\band\b|[,;]"), lambda x: _strip(plain(x), " .()"))
    return F.filter(parts, lambda x: (x != "") & ~is_suspect(x) & ~F.contains(x, F.lit(" ")))


def equivalents(c: Column) -> Column:
    """Forms before the first colon, clean and distinct, in order."""
    parts = F.transform(F.split(F.substring_index(text(c), ":", 1), "[;,]"), clean_form)
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))


def parse_headword(c: Column) -> Column:
    """Struct (form, plain, syllables, stress), or null if the division can't be trusted.

    A part may hold one accent, at its end; one part may be accented; without an
    accent only a single syllable is trusted.
    """
    form = canon(c)
    parts = F.split(form, "-")
    bare = F.transform(parts, lambda p: F.translate(p, "'", ""))
    marked = F.filter(F.transform(parts, lambda p, i: F.when(F.contains(p, F.lit("'")), i)), lambda i: i.isNotNull())
    sound = F.forall(parts, lambda p: (F.length(p) - F.length(F.translate(p, "'", "")) == 0) | p.rlike("^[^']*'$"))
    ok = (form != "") & ~F.contains(form, F.lit(" ")) & ~is_suspect(form) & sound & ~F.array_contains(bare, "")
    ok = ok & (F.size(marked) <= 1) & ((F.size(marked) == 1) | (F.size(parts) == 1))
    stress = F.coalesce(F.get(marked, 0), F.lit(0))
    shown = F.array_join(F.transform(bare, lambda s, i: F.when(i == stress, F.concat(s, F.lit("'"))).otherwise(s)), "-")
    return F.when(ok, F.struct(shown.alias("form"), F.array_join(bare, "").alias("plain"), bare.alias("syllables"), stress.alias("stress")))


def syllable_cuts(syllables: Column) -> Column:
    """Offsets of the borders between syllables."""
    inner = F.slice(syllables, F.lit(1), F.greatest(F.size(syllables) - 1, F.lit(0)))
    sums = F.aggregate(inner, F.array().cast("array<int>"), lambda a, s: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(s))))
    return sums


def pos_canonical(c: Column) -> Column:
    got = F.trim(text(c))
    mapped = reduce(lambda a, kv: F.when(got == kv[0], kv[1]).otherwise(a), POS_ALIASES.items(), got)
    return F.when(mapped != "", mapped)


def words(c: Column) -> Column:
    """Lower-case runs of a to z."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z]+)"), 1)


def gloss_tokens(c: Column) -> Column:
    """Distinct words without stop words, unless nothing is left."""
    stop = F.array(*map(F.lit, GLOSS_STOP))
    return let(F.array_distinct(words(c)), lambda found: let(F.array_except(found, stop), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(found)))


def forms_set(c: Column) -> Column:
    """Distinct plain forms of an answer that lists several."""
    parts = F.transform(F.split(text(c), r"[,;/\n]|\band\b"), lambda x: _strip(plain(x), " .()"))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def normalize_quotes(c: Column) -> Column:
    low = F.translate(F.lower(text(c)), "`*“”’", "  \"\"'")
    return collapse(low)


def compact(c: Column) -> Column:
    """Letters, digits, apostrophes and hyphens only."""
    return F.regexp_replace(normalize_quotes(c), r"[^0-9a-zćšŋḣṡǧáéíóúķśṅźėčž'ʼ-]+", "")


def word_set(c: Column, stop: list[str] = QA_STOP) -> Column:
    """Distinct words of three letters or more, without stop words."""
    found = F.regexp_extract_all(normalize_quotes(c), F.lit(r"([0-9a-zćšŋḣṡǧáéíóúķśṅźėčž'ʼ-]{3,})"), 1)
    # distinct words first, as a long text has most of its words many times
    kept = F.array_except(found, F.array(*map(F.lit, stop)))
    return F.array_remove(F.array_distinct(F.transform(kept, lambda w: F.trim(w, F.lit("-'ʼ")))), "")


def top_keywords(c: Column, n: int = 20) -> Column:
    """The longest words; ties in alphabetic order."""
    return longest(word_set(c), n)


def longest(found: Column, n: int = 20) -> Column:
    """The longest of distinct words; ties in alphabetic order."""
    keyed = F.sort_array(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(keyed, 1, n), lambda s: s["w"])


def marked_terms(c: Column, most: int = 12) -> Column:
    """Quoted or bold terms, then tokens with marked letters; the first of each compact form."""
    quoted = F.regexp_extract_all(text(c), F.lit("`([^`]{2,80})`"), 1)
    bold = F.regexp_extract_all(text(c), F.lit(r"\*\*([^*]{2,80})\*\*"), 1)
    # runs of three or more with a marked letter, hyphen or apostrophe; each is worked on once
    own = "ćšŋḣṡǧáéíóúķśṅźėčž'ʼ-"
    seen = F.regexp_extract_all(text(c), F.lit(f"(?<![A-Za-z{own}])((?=[A-Za-z{own}]{{3}})[A-Za-z]*+[{own}][A-Za-z{own}]*+)"), 1)
    every = F.transform(F.array_distinct(F.concat(quoted, bold, seen)), lambda t: let(_strip(strip_ws(t), ".,;:()[]{}"), lambda x: F.struct(x.alias("t"), compact(x).alias("k"))))
    full = lambda acc, x: (F.size(acc) >= most) | (x["k"] == "") | F.exists(acc, lambda y: y["k"] == x["k"])
    none = F.array().cast("array<struct<t:string,k:string>>")
    firsts = F.aggregate(every, none, lambda acc, x: F.when(full(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(firsts, lambda x: x["t"])


def special_chars(c: Column, alphabet: str = EXPECTED_LETTERS) -> Column:
    """The marked letters of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text(c), F.lit(f"([{alphabet}])"), 1)))


def extract_affixes(*texts: Column) -> Column:
    """Affixes named in the texts, sorted: with a hyphen before, after or inside.

    White space or the start comes before; white space, the end, a comma or a
    full stop after. A border is used up, so of two affixes with one blank
    between them the first counts.
    """
    named = rf"(?:^|[\s\x1c-\x1f\x85])((?:{_WORD}+)?-{_WORD}+|{_WORD}+-)(?:[\s\x1c-\x1f\x85]|$|,|\.)"
    found = [F.regexp_extract_all(text(c), F.lit("(?U)" + named), 1) for c in texts]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def is_plausible_affix(c: Column) -> Column:
    """One hyphen side only, at most eight letters, no blank or slash."""
    token = F.trim(text(c))
    body = _strip(token, "-")
    sides = token.startswith("-") != token.endswith("-")
    return (token != "") & ~token.rlike("[/ ]") & (body != "") & (F.length(body) <= 8) & sides


def strip_affixes(form: Column, affixes: Column) -> Column:
    """Take named affixes off a form, one after the other."""

    def off(f, a):
        bare = F.translate(a, "-", "")
        suffix = a.startswith("-") & F.endswith(f, bare) & (F.length(f) > F.length(bare))
        prefix = F.endswith(a, F.lit("-")) & F.startswith(f, bare) & (F.length(f) > F.length(bare))
        cut = F.when(suffix, F.left(f, F.length(f) - F.length(bare))).when(prefix, F.right(f, F.length(f) - F.length(bare)))
        return F.coalesce(cut, f)

    return F.aggregate(affixes, text(form), off)


def affix_tokens(c: Column, affix: Column) -> Column:
    """Tokens that bear an affix: at their end, at their start, or anywhere."""
    bare = F.lower(F.regexp_replace(affix, "^-+|-+$", ""))
    tokens = F.transform(F.split(collapse(c), " "), lambda t: F.regexp_replace(t, r"(?U)^[^\wʼ]+|[^\wʼ]+$", ""))
    suffix = affix.startswith("-") & ~affix.endswith("-")
    prefix = affix.endswith("-") & ~affix.startswith("-")
    low = lambda t: F.lower(t)
    longer = lambda t: F.length(t) > F.length(bare)
    hit = lambda t: F.when(suffix, F.endswith(low(t), bare) & longer(t)).when(prefix, F.startswith(low(t), bare) & longer(t)).otherwise(F.contains(low(t), bare))
    return F.filter(tokens, lambda t: (t != "") & (bare != "") & hit(t))


#: Letters of a border by which affixes are looked up; plausible affixes have no more than half as many.
BORDER_LETTERS = 16


def affix_border(affix: Column) -> Column:
    """The key of an affix among `token_borders`: its side and its letters; null for one that has no single side."""
    bare = F.lower(F.regexp_replace(affix, "^-+|-+$", ""))
    last, first = affix.startswith("-"), affix.endswith("-")
    return F.when((bare != "") & last & ~first, F.concat(F.lit("-"), bare)).when((bare != "") & first & ~last, F.concat(bare, F.lit("-")))


def token_borders(c: Column) -> Column:
    """Distinct ends and starts of the tokens of a form, each shorter than its token, keyed as `affix_border` does."""
    tokens = F.transform(F.split(collapse(c), " "), lambda t: F.lower(F.regexp_replace(t, r"(?U)^[^\wʼ]+|[^\wʼ]+$", "")))
    sizes = lambda t: F.sequence(F.lit(1), F.least(F.length(t) - 1, F.lit(BORDER_LETTERS)))
    ends = lambda t: F.transform(sizes(t), lambda n: F.concat(F.lit("-"), F.right(t, n)))
    starts = lambda t: F.transform(sizes(t), lambda n: F.concat(F.left(t, n), F.lit("-")))
    return F.array_distinct(F.flatten(F.transform(F.filter(tokens, lambda t: F.length(t) > 1), lambda t: F.concat(ends(t), starts(t)))))


def extract_answer(c: Column) -> Column:
    """Struct (span, parsed): what follows the last ``ANSWER:``, else the last line that isn't blank.

    Closed thinking is dropped; what follows an open one is no answer.
    """
    said = F.regexp_replace(text(c), r"(?s)<think>.*?</think>", "")
    said = F.trim(F.substring_index(F.substring_index(said, "</think>", -1), "<think>", 1))
    marks = F.split(said, r"(?i)ANSWER\s*:", -1)
    after = F.regexp_replace(F.try_element_at(marks, F.lit(-1)), r"^\s+|\s+$", "")
    first = F.trim(F.regexp_extract(after, r"^([^\r\n]*)", 1))
    lines = F.filter(F.transform(F.split(said, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    marked = F.size(marks) > 1
    span = _strip(F.when(marked, first).otherwise(last), " `\"*")
    return F.struct(span.alias("span"), (marked & (first != "")).alias("parsed"))


def extract_final(c: Column) -> Column:
    """The last boxed text, else the last ``final answer`` line, else the last line."""
    said = text(c)
    boxed = F.try_element_at(F.regexp_extract_all(said, F.lit(r"\\boxed\{([^{}]+)\}"), 1), F.lit(-1))
    finals = F.filter(F.regexp_extract_all(said, F.lit(r"(?im)final\s+answer\s*(?:is|:)\s*(.+)$"), 1), lambda x: F.trim(x) != "")
    lines = F.filter(F.transform(F.split(said, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.trim(boxed), F.trim(F.try_element_at(finals, F.lit(-1))), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def extract_option(c: Column) -> Column:
    return F.regexp_extract(F.upper(text(c)), r"\b([A-E])\b", 1)


def clean_answer_display(c: Column, most: int = 280) -> Column:
    """The visible answer, shortened to ``most`` characters."""
    span = extract_answer(c)["span"]
    return F.when(F.length(span) > most, F.concat(F.rtrim(F.left(span, F.lit(most - 1))), F.lit("…"))).otherwise(span)


def fenced_json(c: Column) -> Column:
    """What a JSON fence holds, else the text itself."""
    inner = F.regexp_extract(text(c), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(inner != "", inner).otherwise(text(c)), F.lit(" \t\r\n"))


def json_array_slice(c: Column) -> Column:
    """From the first ``[`` to the last ``]``."""
    return F.nullif(F.regexp_extract(text(c), r"(?s)(\[.*\])", 1), F.lit(""))


def json_flag(c: Column, key: str) -> Column:
    """A flag of a JSON object in a text as 1 or 0; null if there is none."""
    whole = F.regexp_extract(text(c), r"(?s)(\{.*\})", 1)
    value = F.lower(F.get_json_object(whole, f"$.{key}"))
    return F.when(value.isin("true", "yes", "1", "1.0", "correct"), 1.0).when(value.isNotNull(), 0.0)


def levenshtein_norm(a: Column, b: Column) -> Column:
    """Edit distance over the longer length."""
    longest = F.greatest(F.length(text(a)), F.length(text(b)))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(text(a), text(b)) / longest)


def common_prefix_len(a: Column, b: Column) -> Column:
    """Letters that two texts begin with alike: a back reference across a NUL; texts that hold one are cut letter by letter."""
    nul = F.lit("\0")
    fast = F.length(F.regexp_extract(F.concat(a, nul, b), r"(?s)^([^\x00]*)[^\x00]*\x00\1", 1))
    n = F.least(F.length(a), F.length(b))
    hits = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.when(F.contains(a, nul) | F.contains(b, nul), F.array_max(hits)).otherwise(fast)


def single_edit(a: Column, b: Column) -> Column:
    """Struct (old, new, pos): what differs after the common prefix and suffix."""

    def after_prefix(v: Column) -> Column:
        rest = lambda c: F.substring(c, v["pre"] + 1, F.length(c))
        tails = F.struct(rest(v["a"]).alias("a"), rest(v["b"]).alias("b"))
        return let(tails, lambda r: let(common_prefix_len(F.reverse(r["a"]), F.reverse(r["b"])), lambda suf: F.struct(F.left(r["a"], F.length(r["a"]) - suf).alias("old"), F.left(r["b"], F.length(r["b"]) - suf).alias("new"), v["pre"].alias("pos"))))

    return let(F.struct(a.alias("a"), b.alias("b"), common_prefix_len(a, b).alias("pre")), after_prefix)


def is_placeholder(c: Column) -> Column:
    quoted = "|".join("".join("\\" + x if not x.isalnum() and x != " " else x for x in p) for p in PLACEHOLDERS)
    return text(c).rlike(f"(?i){quoted}")


def has_marked_letter(c: Column) -> Column:
    """A letter outside ASCII, or a combining mark."""
    return text(c).rlike(r"[\p{L}&&[^\x00-\x7F]]|[̀-ͯ]")


def english_metalanguage(c: Column) -> Column:
    """Whether a gold talks about grammar in English rather than giving a form."""
    value = F.trim(text(c))
    low = F.lower(value)
    tokens = F.transform(F.regexp_extract_all(value, F.lit("([A-Za-z']+)"), 1), lambda t: F.lower(t))
    array = lambda xs: F.array(*map(F.lit, xs))
    several = (F.size(tokens) >= 2) & (F.arrays_overlap(tokens, array(META_FUNCTION + META_NOUNS)) | value.rlike(r"(?i)\b(" + "|".join(META_GLOSS) + r")\b"))
    single = (F.size(tokens) == 1) & F.arrays_overlap(tokens, array(META_TERMS))
    return (value != "") & (is_placeholder(value) | (~has_marked_letter(value) & (low.isin(META_TERMS + META_PHRASES) | several | single)))


def gold_language(c: Column) -> Column:
    """empty, placeholder, dakota_markers, english_like or ascii_or_unknown."""
    return F.when(F.trim(text(c)) == "", "empty").when(is_placeholder(c), "placeholder").when(has_marked_letter(c), "dakota_markers").when(english_metalanguage(c), "english_like").otherwise("ascii_or_unknown")


def orthography_probable(c: Column) -> Column:
    """At least one marked letter, else a combining mark."""
    return text(c).rlike(f"[{ORTHOGRAPHIC_MARKERS}\u0300-\u036f]")


def difficulty_rule(confidence: Column, examples: Column) -> Column:
    """Of a rule: harder with less confidence or fewer examples."""
    conf = F.coalesce(confidence, F.lit(0.5))
    return F.when((conf < 0.6) | (examples < 2), "hard").when((conf < 0.8) | (examples < 4), "medium").otherwise("easy")


def difficulty_entry(english: Column, notes: Column, examples: Column) -> Column:
    """Of an entry: words of its definition, 5 for notes, 2 for each example."""
    n = F.size(F.filter(F.split(collapse(english), " "), lambda t: t != ""))
    n = n + F.when(F.trim(text(notes)) != "", 5).otherwise(0) + 2 * F.greatest(F.coalesce(F.size(examples), F.lit(0)), F.lit(0))
    return F.when(n <= 6, "easy").when(n <= 16, "medium").otherwise("hard")


# The keywords of a term and the rule type they mean, first match first.
TERM_TYPES = [("prefix|suffix|affix", "morphology"), ("negative|negation", "syntax"), ("phonology|sound", "phonology"), ("translat", "translation")]


def term_rule_type(c: Column) -> Column:
    low = F.lower(text(c))
    return reduce(lambda a, kv: F.when(low.rlike(kv[0]), kv[1]).otherwise(a), reversed(TERM_TYPES), F.lit("morphology"))


def redact_key(c: Column) -> Column:
    return F.regexp_replace(text(c), r"sk-[A-Za-z0-9_-]{8,}", "sk-***")


def retry_delay(c: Column) -> Column:
    """Seconds named in an error text."""
    found = F.regexp_extract(F.lower(text(c)), r"(?:retry in|retrydelay\D*)\s*([0-9.]+)\s*s", 1)
    return found.try_cast("double")


def version_tuple(c: Column) -> Column:
    """Dotted version as an array of numbers, which compares in order."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(text(c), r"^([0-9.]*)", 1), F.lit("([0-9]+)"), 1), lambda p: p.cast("int"))


def hide_leak(prompt: Column, gold: Column, pattern: Column) -> Column:
    """A prompt without what gives its gold or pattern away.

    A block of examples that holds one of them goes; a pattern line that is one of
    two letters or more is hidden. Without either the prompt is only stripped.
    """
    needles = F.filter(F.transform(F.array(gold, pattern), strip_ws), lambda n: n != "")
    block = r"(?d)\n+Examples:\n(?:[ \t]*-[ \t]*.+\n?)+"
    told = F.regexp_extract_all(text(prompt), F.lit(block), 0)
    kept = F.transform(told, lambda b: F.when(F.exists(needles, lambda n: F.contains(b, n)), F.lit("\n")).otherwise(b))
    between = F.split(text(prompt), block, -1)
    rest = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(kept, i), F.lit("")))), "")
    line = lambda n: F.concat(F.lit(r"(?imud)^Pattern:(?U:\s*)\Q"), F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?U:\s*)$"))
    hidden = F.aggregate(F.filter(needles, lambda n: F.length(n) >= 2), rest, lambda t, n: F.regexp_replace(t, line(n), F.lit("Pattern: [hidden]")))
    return strip_ws(hidden)


def sha_bucket(c: Column) -> Column:
    """sha256 as a number, modulo ten (16^k leaves 6 for k >= 1)."""
    h = F.sha2(text(c), 256)
    # parts of 15 digits fit a long; all but the last are followed by more digits
    parts = [F.conv(F.substring(h, at, 15), 16, 10).cast("long") % 10 for at in (1, 16, 31, 46, 61)]
    return ((6 * reduce(lambda a, p: a + p, parts[:-1]) + parts[-1]) % 10).cast("int")


def image_tokens(width: Column, height: Column, patch: int = 28) -> Column:
    return (F.ceil(width / patch) * F.ceil(height / patch)).cast("long")


def token_overhead(n_messages: Column, content_tokens: Column) -> Column:
    """Tokens of a chat: four a message, three for the reply, plus the contents."""
    return content_tokens + 4 * n_messages + 3
