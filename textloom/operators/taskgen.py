"""Row expansion: entries, rules, texts and conversations to tasks and training rows.

A maker is a struct expression that is null where its row is not eligible; rows
expand by exploding the makers that aren't. Nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X

# Prompts of the lexicon tasks.
PROMPTS = {
    "gloss": "Give the English definition of the Dakota word: {w}",
    "syllabify": "Write the Dakota word with Riggs' syllable division and accent mark (example: a-hi'-yo-ka-sin): {w}",
    "pos": "Give Riggs' part-of-speech abbreviation for the Dakota word: {w}",
    "inflect": "Give the inflected form or forms that Riggs lists under the Dakota word: {w} ({pos})",
    "root": "Give the Dakota word from which this word is derived: {w}",
    "en_to_dak": "Give the Dakota word for the English word: {w} ({pos})",
    "lookup_gloss": "Read the dictionary. What is the English definition of the Dakota word {w}?",
    "lookup_root_gloss": "Read the dictionary. The Dakota word {w} is derived from another word. What is the English definition of that other word?",
}


def fill(template: str, **values: Column) -> Column:
    """A template with columns in place of its names."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def _task(kind: str, when: Column, split: Column, w: Column, answer: Column, accepted: Column, hops: int | None = None, target: Column | None = None, pos: Column | None = None) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("task"),
            split.alias("split"),
            fill(PROMPTS[kind], w=w, pos=F.coalesce(pos, F.lit("?")) if pos is not None else F.lit("")).alias("prompt"),
            answer.alias("answer"),
            accepted.alias("accepted"),
            F.lit(hops).cast("int").alias("hops"),
            (F.lit(None).cast("string") if target is None else target).alias("target_plain"),
        ),
    )


def explode_makers(rows: DataFrame, makers: list[Column], keep: list[str]) -> DataFrame:
    """One row for each maker that isn't null, with its number; each maker is computed once a row."""
    made = rows.select(*keep, F.posexplode(F.array(*makers)).alias("maker", "t")).filter("t IS NOT NULL")
    return made.select(*keep, "maker", "t.*")


def entry_to_tasks(entries: DataFrame) -> DataFrame:
    """Up to seven tasks of a trusted entry.

    ``entries`` has entry_id, plain, headword, syllables, pos, gloss,
    inflected_forms, derived_from, headword_ok and split. Accepted answers come
    from all entries that share the plain form; a root must be an entry, and the
    two-step lookup needs exactly one root with exactly one entry that has a gloss.
    """
    ok = entries.filter("headword_ok")
    same = ok.groupBy("plain").agg(
        F.count("*").alias("n_same"),
        F.countDistinct("headword").alias("n_heads"),
        F.array_sort(F.collect_set(F.nullif("pos", F.lit("")))).alias("all_pos"),
        F.array_sort(F.collect_set(F.nullif("gloss", F.lit("")))).alias("all_glosses"),
        F.min_by("gloss", "entry_id").alias("first_gloss"),
    )
    df = ok.join(same, "plain")
    refs = ok.select("entry_id", F.posexplode("derived_from").alias("i", "ref"))
    heads = same.select(F.col("plain").alias("ref"), F.col("n_same").alias("root_n"), F.col("first_gloss").alias("root_gloss"))
    roots = refs.join(heads, "ref", "left").groupBy("entry_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "ref"))), lambda x: x["ref"]).alias("roots"),
        F.bool_and(F.col("root_n").isNotNull()).alias("all_roots"),
        F.min_by("root_n", "i").alias("root_n"),
        F.min_by("root_gloss", "i").alias("root_gloss"),
    )
    df = df.join(roots, "entry_id", "left").withColumn("all_roots", F.coalesce("all_roots", F.lit(False)))
    w, sp, one = F.col("plain"), F.col("split"), lambda c: F.array(F.col(c))
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    makers = [
        _task("syllabify", (F.size("syllables") > 1) & (F.col("n_heads") == 1), sp, w, F.col("headword"), one("headword")),
        _task("pos", F.col("pos").isin(X.POS_CLOSED), sp, w, F.col("pos"), F.col("all_pos")),
        _task("inflect", F.size("inflected_forms") > 0, sp, w, F.array_join("inflected_forms", ", "), F.col("inflected_forms"), pos=F.col("pos")),
        _task("root", F.col("all_roots"), sp, w, F.array_join("roots", ", "), F.col("roots")),
        _task("lookup_root_gloss", F.col("all_roots") & (F.size("roots") == 1) & (F.col("root_n") == 1) & has("root_gloss"), sp, w, F.col("root_gloss"), F.array("root_gloss"), 2, F.get("roots", 0)),
        _task("gloss", has("gloss") & (sp == "train"), sp, w, F.col("gloss"), F.col("all_glosses")),
        _task("lookup_gloss", has("gloss"), sp, w, F.col("gloss"), F.col("all_glosses"), 1, w),
    ]
    return explode_makers(df, makers, ["entry_id"]).withColumn("id", F.concat_ws(":", "task", "entry_id"))


def english_to_tasks(entries: DataFrame) -> DataFrame:
    """A task with every form of a training entry, and one with the forms both witnesses have."""
    df = entries.filter((F.size("forms") > 0) & (F.col("split") == "train"))
    tier = lambda col, name: F.when(F.size(col) > 0, F.struct(F.lit(name).alias("gold_tier"), F.col(col).alias("accepted")))
    out = explode_makers(df, [tier("forms", "all_forms"), tier("attested_forms", "two_witnesses")], ["entry_id", "english", "pos", "split"])
    prompt = fill(PROMPTS["en_to_dak"], w=F.col("english"), pos=F.coalesce("pos", F.lit("?")))
    return out.select("entry_id", F.lit("en_to_dak").alias("task"), "split", prompt.alias("prompt"), F.get("accepted", 0).alias("answer"), "accepted", "gold_tier")


def dropped_english(entries: DataFrame) -> DataFrame:
    """How many entries with forms the held-out split drops."""
    return entries.agg(F.count_if((F.size("forms") > 0) & (F.col("split") != "train")).alias("dropped"))


def format_entry(headword: Column, pos: Column, gloss: Column, derived: Column, forms: Column, page: Column) -> Column:
    """What a dictionary lookup shows."""
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f" [{name}: "), F.array_join(c, ", "), F.lit("]"))).otherwise("")
    lead = F.concat_ws(", ", headword, F.nullif(F.trim(X.text(pos)), F.lit("")), F.coalesce(F.nullif(gloss, F.lit("")), F.lit("(no definition printed)")))
    return F.concat(lead, listed("derived from", derived), listed("forms", forms), F.lit(" (scan page "), page.cast("string"), F.lit(")"))


def _lines(*parts: Column) -> Column:
    return F.concat(F.concat_ws("\n", *parts), F.lit("\n"))


def _line(label: str, c: Column) -> Column:
    return F.when(F.trim(X.text(c)) != "", F.concat(F.lit(label), c))


def entry_to_bidirectional(entries: DataFrame) -> DataFrame:
    """A forward and a backward translation task of each entry (dakota, english, pos, morphological_notes, examples)."""
    first = F.get("examples", F.lit(0))
    level = X.difficulty_entry(F.col("english"), F.col("morphological_notes"), F.col("examples"))
    forward = F.struct(
        F.lit("dakota_to_english").alias("direction"),
        _lines(F.lit("Translate the following Dakota headword into natural English."), F.concat(F.lit("Dakota: "), "dakota"), _line("Part of speech: ", F.col("pos")), _line("Morphology: ", F.col("morphological_notes")), _line("Example usage: ", first)).alias("prompt"),
        F.col("english").alias("answer"),
    )
    backward = F.struct(
        F.lit("english_to_dakota").alias("direction"),
        _lines(F.lit("Which Dakota headword best matches this English description?"), F.concat(F.lit("Definition: "), "english"), _line("Target part of speech: ", F.col("pos")), _line("Example clue: ", first), _line("Morphological hints: ", F.col("morphological_notes"))).alias("prompt"),
        F.col("dakota").alias("answer"),
    )
    return entries.select("entry_id", level.alias("difficulty"), F.explode(F.array(forward, backward)).alias("t")).select("entry_id", "difficulty", "t.*")


def to_instruction(entries: DataFrame) -> DataFrame:
    """Instruction rows with the entry's context."""
    context = F.concat_ws(
        "\n",
        _line("Part of speech: ", F.col("pos")),
        _line("Morphology: ", F.col("morphological_notes")),
        F.when(F.size("examples") > 0, F.concat(F.lit("Examples: "), F.array_join("examples", " | "))),
    )
    shown = F.concat(F.lit("Dakota: "), F.col("dakota"), F.lit("\n"), F.coalesce(F.nullif(context, F.lit("")), F.lit("No additional context available.")))
    return entries.select("entry_id", F.lit("Translate the Dakota headword to English.").alias("instruction"), shown.alias("input"), F.col("english").alias("output"))


def _example(e: Column, name: str) -> Column:
    return F.coalesce(e[name], F.lit(""))


def rule_to_tasks(rules: DataFrame) -> DataFrame:
    """Tasks of each rule, by its type, examples, negatives and exceptions.

    ``rules`` has rule_id, rule_type, rule_description, dakota_pattern,
    constraints, difficulty, positive_examples and negative_examples (arrays of
    dakota, english, gloss, notes) and exceptions. Order: rule, example, maker.
    """
    df = rules.withColumn("affixes", X.extract_affixes(F.col("dakota_pattern"), F.col("constraints")))
    has = lambda c: F.trim(X.text(c)) != ""
    desc, pattern, level = F.col("rule_description"), F.col("dakota_pattern"), F.col("difficulty")
    add = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")

    def made(kind, when, prompt, answer, difficulty, base=None, required=None):
        none = F.array().cast("array<string>")
        return F.when(when, F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("task_type"), prompt.alias("prompt"), answer.alias("answer"), difficulty.alias("difficulty"), (F.lit("") if base is None else base).alias("base_form"), (none if required is None else required).alias("required_affixes")))

    # computed once a row, before the makers that use them
    dak, eng, gloss, notes = (F.col(f"__{k}") for k in ("dakota", "english", "gloss", "notes"))
    both, morph = has(dak) & has(eng), (F.col("rule_type") == "morphology") & has(dak)
    short, base = F.col("__short"), F.col("__base")
    per_example = [
        made(F.when(short, "word_translation").otherwise("sentence_translation"), both, F.concat(F.lit("Translate this Dakota sentence to English:\n\n"), dak, add(has(gloss), "\n\nGloss: ", gloss)), eng, level),
        made("reverse_translation", both & level.isin("medium", "hard"), F.concat(F.lit("Translate this English sentence to Dakota:\n\n"), eng, add(has(notes), "\n\nNote: ", notes)), dak, F.lit("advanced")),
        made("morphology", morph, F.concat(F.lit("Apply this Dakota grammar rule: "), desc, F.lit("\n\n"), add(has(pattern), "Pattern: ", pattern, "\n\n"), add(has(notes), "Context: ", notes, "\n\n"), F.lit("Transform or analyze: "), dak), F.when(F.col("__none"), dak).otherwise(eng), level, dak, F.col("affixes")),
        made("multi_step_morphology", morph & (F.size("affixes") >= 2), F.concat(F.lit("Apply this Dakota grammar rule step-by-step: "), desc, F.lit("\n\nPattern: "), X.text(pattern), F.lit("\n\nStart with: "), dak, F.lit("\n\nTask: Apply the affixes in order to create the complete form.\nShow each intermediate step:\n1. Base form\n2. After first affix\n3. Final form with all affixes\n")), F.concat(F.lit("Step 1: "), dak, F.lit("\n"), add(has(eng), "Step 2: [apply first affix]\nFinal: ", dak, " [with all affixes applied]")), F.lit("hard"), dak, F.col("affixes")),
        made("affix_insertion", morph & (F.size("affixes") > 0) & (base != dak), F.concat(F.lit("Insert the Dakota affix(es) into the base form:\n\nBase form: "), base, F.lit("\nAffix(es) to insert: "), F.array_join("affixes", ", "), F.lit("\nRule: "), desc, F.lit("\n\nShow where each affix should be inserted and write the complete form.")), F.concat(dak, add(has(eng), " (", eng, ")")), F.lit("medium"), base, F.col("affixes")),
        made("syntax", (F.col("rule_type") == "syntax") & has(dak), F.concat(F.lit("Analyze the syntax of this Dakota sentence:\n\n"), dak, F.lit("\n\nRule: "), desc, add(has(gloss), "\n\nGloss: ", gloss)), X.first_truthy(eng, F.col("english_explanation")), level),
    ]
    used = ["rule_id", "rule_type", "rule_description", "dakota_pattern", "english_explanation", "difficulty", "affixes"]
    examples = df.select(*used, F.posexplode("positive_examples").alias("example", "ex"))
    examples = examples.select(*used, "example", *(_example(F.col("ex"), k).alias(f"__{k}") for k in ("dakota", "english", "gloss", "notes")), F.col("ex.english").isNull().alias("__none"))
    words = F.when(dak.rlike(r"(?U)\s"), F.size(F.filter(F.split(X.collapse(dak), " "), lambda t: t != ""))).otherwise(1)
    bare = F.when((F.col("rule_type") == "morphology") & (F.size("affixes") > 0), X.strip_affixes(dak, F.col("affixes"))).otherwise(dak)
    examples = examples.select("*", (words <= 3).alias("__short"), bare.alias("__base"))
    of_examples = explode_makers(examples, per_example, ["rule_id", "example"])

    pos, neg = F.get("positive_examples", F.lit(0)), F.get("negative_examples", F.lit(0))
    n_pos, n_neg, n_exc = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in ("positive_examples", "negative_examples", "exceptions"))
    shown = lambda x: F.concat(X.text(x["dakota"]), add(has(x["english"]), " - ", x["english"]))
    bullets = lambda xs, n: F.array_join(F.transform(F.slice(xs, 1, n), lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), "")
    named = lambda xs: F.transform(F.filter(xs, lambda x: F.trim(X.text(x["dakota"])) != ""), lambda x: x["dakota"])
    per_rule = [
        made("identify_pattern", has(pattern), F.concat(F.lit("Identify the grammatical pattern in this Dakota rule:\n\n"), desc, F.lit("\n\n"), add(n_pos > 0, "Examples:\n", bullets(named(F.slice("positive_examples", 1, 2)), 2))), pattern, level),
        made("positive_negative_evidence", (n_pos > 0) & (n_neg > 0), F.concat(F.lit("Study this Dakota grammar rule: "), desc, F.lit("\n\nCorrect example (follows the rule):\n   "), shown(pos), F.lit("\n\nIncorrect example (violates the rule):\n   "), shown(neg), F.lit("\n\nExplain why the incorrect example is wrong and how to fix it.")), F.concat(F.lit("The incorrect example violates the rule because: [explanation]. The correct form should follow the pattern: "), F.coalesce(pattern, F.lit("N/A"))), F.lit("medium")),
        made("exception_trigger", (n_pos > 0) & ((n_exc > 0) | (n_neg > 0)), F.concat(F.lit("This Dakota grammar rule has exceptions: "), desc, F.lit("\n\nPattern: "), X.text(pattern), F.lit("\n\n"), add(n_exc > 0, "Exceptions:\n", bullets(F.col("exceptions"), 3), "\n"), add(n_neg > 0, "Words that DON'T follow this rule:\n", bullets(named(F.slice("negative_examples", 1, 2)), 2), "\n"), F.lit("Explain why these are exceptions and what rule they follow instead.")), F.concat(F.lit("These words are exceptions because: [explanation]. "), add(has(F.col("constraints")), "They don't meet the constraint: ", F.col("constraints"))), F.lit("hard")),
    ]
    of_rules = explode_makers(df.withColumn("example", F.lit(1 << 30)), per_rule, ["rule_id", "example"])
    return of_examples.unionByName(of_rules)


def interlinear_to_tasks(texts: DataFrame) -> DataFrame:
    """Word tasks of words and glosses side by side (the shorter list counts), the sentence, and the reverse."""
    n = F.least(F.size("words"), F.size("glosses"))
    pairs = F.slice(F.arrays_zip("words", "glosses"), F.lit(1), n)
    word = F.transform(pairs, lambda p: F.struct(F.lit("word_translation").alias("task_type"), F.concat(F.lit("Translate Dakota word to English: "), p["words"]).alias("prompt"), p["glosses"].alias("answer")))
    whole = F.array(
        F.struct(F.lit("sentence_translation").alias("task_type"), F.concat(F.lit("Translate Dakota sentence to English: "), "dakota").alias("prompt"), F.col("english").alias("answer")),
        F.struct(F.lit("reverse_translation").alias("task_type"), F.concat(F.lit("Translate English to Dakota: "), "english").alias("prompt"), F.col("dakota").alias("answer")),
    )
    return texts.select("text_id", F.posexplode(F.concat(word, whole)).alias("pos", "t")).select("text_id", "pos", "t.*")


def conversation_prefixes(rows: DataFrame, conv: str, turn: str, role: str, content: str) -> DataFrame:
    """One row for each assistant turn: the conversation up to it, as messages."""
    order = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumn("messages", F.collect_list(F.struct(F.col(role).alias("role"), F.col(content).alias("content"))).over(order))
    return df.filter(F.col(role) == "assistant").select(conv, turn, "messages")


def to_chat(rows: DataFrame, system: str, question: str, answer: str, keep: list[str]) -> DataFrame:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.select(*keep, F.array(message("system", F.lit(system)), message("user", F.col(question)), message("assistant", F.col(answer))).alias("messages"))


def transformations_to_tasks(rules: DataFrame, most: int = 10) -> DataFrame:
    """One task for each of the first transformations (base, result, gloss) of a testable rule."""
    t = rules.filter("testable").select("rule_id", F.posexplode(F.slice("transformations", 1, most)).alias("i", "t"))
    return t.select("rule_id", "i", F.concat(F.lit("Transform: "), F.col("t.base")).alias("prompt"), F.col("t.result").alias("answer"))


def page_to_rules(pages: DataFrame) -> DataFrame:
    """Rules, interlinear texts and terms of a page as one rule table (page, kind, rule_id, rule_type, description, pattern, n_examples, confidence)."""
    cols = ["page", "kind", "rule_id", "rule_type", "description", "pattern", "n_examples", "confidence"]
    r = pages.select("page", F.explode("rules").alias("r")).select("page", F.lit("rule").alias("kind"), "r.rule_id", "r.rule_type", F.col("r.description"), F.col("r.pattern"), F.size("r.examples").alias("n_examples"), F.coalesce("r.confidence", F.lit(0.5)).alias("confidence"))
    t = pages.select("page", F.explode("texts").alias("t")).filter(F.size("t.lines") > 0).select("page", F.lit("text").alias("kind"), F.concat("t.text_id", F.lit("_translation")).alias("rule_id"), F.lit("translation").alias("rule_type"), F.lit("Complete sentence translation with interlinear gloss").alias("description"), F.array_join("t.lines", " ").alias("pattern"), F.lit(1).alias("n_examples"), F.coalesce("t.confidence", F.lit(0.7)).alias("confidence"))
    m = pages.select("page", F.explode("terms").alias("m")).filter((F.trim("m.term") != "") & (F.trim("m.definition") != "")).select("page", F.lit("term").alias("kind"), F.format_string("term_p%d_%s", "page", F.left(F.translate("m.term", " -", "__"), F.lit(30))).alias("rule_id"), X.term_rule_type(F.col("m.term")).alias("rule_type"), F.col("m.definition").alias("description"), F.col("m.term").alias("pattern"), F.greatest(F.size("m.examples"), F.lit(1)).alias("n_examples"), F.lit(0.8).alias("confidence"))
    return reduce(DataFrame.unionByName, [d.select(*cols) for d in (r, t, m)])


def lookup_dialogue(tasks: DataFrame, shown: DataFrame) -> DataFrame:
    """Solved lookup conversations: a lookup for each hop, then the answer; tasks with a missing entry go.

    ``tasks`` has id, word, target_plain, hops, prompt and answer; ``shown`` has
    plain and text. The last text is that of the target, so a replay sees it.
    """
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    first = shown.select(F.col("plain").alias("word"), F.col("text").alias("t1"))
    second = shown.select(F.col("plain").alias("target_plain"), F.col("text").alias("t2"))
    df = tasks.join(first, "word").join(second, "target_plain")
    ask = lambda c: say("assistant", F.concat(F.lit("LOOKUP: "), c))
    one = F.array(say("user", F.col("prompt")), ask(F.col("word")), say("user", F.col("t1")))
    two = F.when(F.col("hops") == 2, F.array(ask(F.col("target_plain")), say("user", F.col("t2")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return df.select("id", F.concat(one, two, F.array(say("assistant", F.concat(F.lit("ANSWER: "), "answer")))).alias("messages"))
