"""The wide audits: QA01, QA07, QA15 and QA17, each one projection of named checks and one explode.

A case has case_id, source, q_type, hash_id, question, prompt, narrative, title,
category, exam_type, hypothesis, rationale, images (array of strings), options
(array of id, text, is_correct, votes) and distractors (map of texts). What
spans cases (repeated ids, hashes, texts; files that are not there) is an
aggregate on narrow columns, joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sql_pattern, trimmed
from .audit import issues

# Signs in texts, as the published audits name them.
PHANTOM = r"(?i)\b(gambar|radiologi|ekg|ecg|ct scan|mri|x-ray|panah|berikut ini|di bawah ini|menunjukkan gambaran|figure \d|as shown|radiograph|chest x|xray|rontgen|foto thorax|foto polos|usg|ultrasonografi|histopatolog|mikroskop|preparat|sediaan|dermoskop)\b"
PHANTOM_DEEP = r"(?i)\b(refer to image|as shown in figure|x-ray reveals|gambar|berikut ini|di bawah ini|menunjukkan gambaran|figure \d|radiograph|chest x|foto thorax|histopatolog|mikroskop|preparat|dermoskop|ekg|ecg|ct scan|mri)\b"
TRAILING = r"(?i)(?: the| and| of| with| is| a| to| in| or| yang| dan| di| ke| pada| untuk| dari| oleh)$"
ENCODING = r"(?i)(?:â€™|â€”|â€\"|â€œ|â€|Ã©|Ã¡|Ã±|ï¿½|&#x[0-9a-f]+;|\\u00[0-9a-f]{2})"
MIXED = r"(?i)señal|diagnóstico|tratamiento|es una|não|रोग|উত্তর"
NEGATIVE_QUESTION = r"(?i)\b(?:except|false|incorrect|not true|wrong|least likely|least appropriate|not correct)\b"
NEGATIVE_CONTEXT = r"\b(?:not|except|incorrect|false|wrong|least|never|contraindicated|bukan|tidak|without)\b"
POSITIVE_CONTEXT = r"\b(?:is|are|was|were|causes?|caused by|associated with|seen in|used for|treats?|recommended|first line|most common|classic|feature of|diagnosis|answer)\b"
URL_ONLY = r"(?i)^(?:https?://\S+|www\.\S+)$"
PLACEHOLDER = r"(?i)^(?:reference\s*:.*|see reference(?: for detailed explanation)?\.?)$"
UNAVAILABLE = r"(?i)^explanation unavailable\.$"
NAMES_ANSWER = r"(?:correct answer|best answer|answer|jawaban(?:nya)?|diagnosis(?: paling mungkin| paling tepat)?|correct option)"
LETTERS = (rf"(?i)\b{NAMES_ANSWER}\s*(?:is|adalah|:|=)?\s*(?:option\s*|choice\s*)?\(?([A-F])\)?\b", r"(?i)\boption\s*\(?([A-F])\)?\s*(?:is|was)\s*(?:the\s+)?(?:correct|best|right)\b")
TEXTS = (rf'(?i){NAMES_ANSWER}\s*(?:is|adalah|:|=)\s*["“]?([^"”.\n]{{3,160}})', r'(?i)["“]([^"”\n]{3,160})["”]\s+is\s+(?:the\s+)?(?:correct|best|right|diagnosis|answer)')
CUE, COPULA = r"\b(?:correct|best|right|answer|diagnosis|treatment)\b", r"\b(?:is|are|was|were)\b"
CATEGORIES = ["internal-medicine", "surgery", "obgyn", "pediatrics", "neurology", "psychiatry", "emergency", "public-health"]
EXAM_TYPES = ["USMLE", "UKMPPD", "MIR-Spain", "Academic", "Research", "Clinical"]
PANEL_LABELS, YES_NO = ["-2", "-1", "0", "+1", "+2"], ["maybe", "no", "yes"]
ABSOLUTE = r"(?i)\b(selalu|tidak pernah|semua|always|never|must|pasti|absolut|100%)\b"
POISON = r"(?i)\b(semua benar|di atas|di bawah|all of the above|none of the above|opsi [a-e]|option [a-e]|both [a-e]|a dan b|a and b|b and c|c and d)\b"
NEGATION = r"(?i)\b(kecuali|except|not true|least likely|bukan|tidak benar|incorrect|false statement|contraindicated)\b"
AFFIRMS = r"(?i)(adalah pilihan utama|is the (correct|recommended|best)|paling tepat|is true because|merupakan (jawaban|pilihan) yang (benar|tepat))"
WITHDRAWN = r"(?i)\b(ranitidine|ranitidin|cisapride|sibutramine|rofecoxib|troglitazone|dextropropoxyphene|tegaserod|phenylpropanolamine)\b"
OUTDATED = r"(?i)\b(JNC\s*7|JNC\s*VI|ATP\s*III|AHA\s*201[0-5]|WHO\s*201[0-5]|ACOG\s*201[0-5])\b"
SUGAR, AMOUNT = r"(?i)\b(gluc|sugar|gula|glukosa|blood sugar)\b", r"(?i)\b(\d+\.?\d*)\s*(mg/dl|mmol/l|mg%)?"
STEM = r"(?i)\b(which of the following|what is the most likely|what is the next|what is the best|the most appropriate|which one|which statement)\b"
MARKDOWN, MARKUP = r"\*\*[^*]+\*\*|__[^_]+__", r"(?i)<(br|p|div|span|img|table|tr|td|th|ul|ol|li|h[1-6]|strong|em|a)\b"
BOOKS = r"(?i)\bRef\b.*\b(gangong|guyton|robbins|harrison|schwartz|sabiston|bailey|nelson|hangman|essesntial)"
ENGLISH = r"(?i)\b(presents to|year-old|complains of|history of|physical exam)\b"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def plain(c: Column) -> Column:
    """Lower case, quotes gone, letters, digits and +/- of ASCII, single blanks."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['\"“”‘’`]", "")
    return F.trim(F.regexp_replace(c, "[^a-z0-9+/-]+", " "))


def _right() -> Column:
    return F.filter("options", lambda o: o["is_correct"])


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def _repeats(df: DataFrame, key: Column, name: str) -> DataFrame:
    """``df`` with the number of rows that share ``key`` (null has none), by an aggregate on the key alone."""
    keyed = df.withColumn("_key", key)
    counts = keyed.where("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias(name))
    return keyed.join(counts.where(F.col(name) > 1), "_key", "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(1)))


def audit_structure(df: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """QA01: layer A. Options, key, question text, images, hashes, category."""
    full = trimmed(F.concat_ws(" ", _text("narrative"), _text("prompt")))
    end = lambda n: F.right(full, F.lit(n))  # noqa: E731  longer than what a pattern of the end can reach
    short = (F.length(full) > 0) & (F.length(full) < 200)
    mcq, has = F.col("q_type") == "MCQ", F.coalesce(F.size("images"), F.lit(0)) > 0
    rows = _repeats(df, F.nullif("hash_id", F.lit("")), "_hashes")
    return issues(
        rows,
        "A",
        [
            ("few_options", "critical", F.coalesce(F.size("options"), F.lit(0)) < 2),
            ("no_correct", "critical", mcq & (F.size(_right()) == 0)),
            ("multi_correct", "medium", mcq & (F.size(_right()) > 1)),
            ("empty_question", "critical", (F.length(_text("narrative")) < 10) & (F.length(_text("prompt")) < 10)),
            ("brackets", "medium", short & (_count(full, "(") != _count(full, ")"))),
            ("trailing_stop_word", "medium", short & end(9).rlike(sql_pattern(TRAILING))),
            ("no_terminal", "low", short & (F.length(full) < 80) & ~end(1).rlike(sql_pattern('[.?!:")]$'))),
            ("phantom_image", "medium", full.rlike(sql_pattern(PHANTOM)) & ~has),
            ("empty_option", "medium", F.exists("options", lambda o: F.length(trimmed(F.coalesce(o["text"], F.lit("")))) < 1)),
            ("duplicate_hash", "medium", F.col("_hashes") > 1),
            ("bad_category", "low", ~F.coalesce(F.col("category").isin(*categories), F.lit(False))),
        ],
    )


def _named_option(rationale: Column, low: Column, texts: Column) -> Column:
    """Place of the option that an explanation names: by letter, by its text, or by a cue beside its text.

    ``low`` and ``texts`` are the explanation and the options' texts in plain form.
    """
    options = F.col("options")
    placed = F.transform(texts, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    first = lambda holds: F.array_min(F.transform(F.filter(placed, holds), lambda x: x["i"]))
    out = []
    for pattern in LETTERS:
        letter = F.upper(F.regexp_extract(rationale, pattern, 1))
        at = F.ascii(letter) - 65
        by_id = F.array_position(F.transform(options, lambda o: F.upper(F.trim(o["id"]))), letter) - 1
        out.append(F.when(letter != "", F.coalesce(F.when(by_id >= 0, by_id.cast("int")), F.when(at < F.size(options), at))))
    for pattern in TEXTS:
        said = plain(F.regexp_extract(rationale, pattern, 1))
        fits = F.filter(placed, lambda x: (x["t"] != "") & (said.contains(x["t"]) | x["t"].contains(said)))  # noqa: B023
        out.append(F.when((said != "") & (F.size(fits) == 1), F.get(fits, F.lit(0))["i"]))

    def cued(x: Column) -> Column:
        t = x["t"]
        at = F.instr(low, t)
        start = F.greatest(at - 30, F.lit(1))
        window = F.substr(low, start, at + F.length(t) + 30 - start)
        return F.length(t).between(5, 120) & (at > 0) & window.rlike(CUE) & window.rlike(COPULA)

    return F.coalesce(*out, first(cued))


def _affirmed(low: Column, t: Column) -> Column:
    """Whether an explanation speaks well of a text (both in plain form): words of that kind and none of the other within 40 characters of it."""
    at = F.instr(low, t)
    first = F.greatest(at - 40, F.lit(1))
    window = F.substr(low, first, at + F.length(t) + 40 - first)
    return (F.length(t) >= 5) & (at > 0) & ~window.rlike(NEGATIVE_CONTEXT) & window.rlike(POSITIVE_CONTEXT)


def full_audit(df: DataFrame, files: DataFrame) -> DataFrame:
    """QA07: the 21 published categories; ``files`` (name) are the images that are there."""
    best = F.coalesce(*[F.nullif(F.trim(_text(c)), F.lit("")) for c in ("question", "narrative", "prompt", "title")], F.lit(""))
    keyed = df.withColumn("_prefix", F.substring(plain(best), 1, 80))
    groups = keyed.where(F.length("_prefix") >= 25).groupBy("_prefix").agg(F.count_distinct("case_id").alias("_ids"), F.count_distinct("source").alias("_sources")).where("_ids > 1 and _sources > 1")
    shown = df.select("case_id", F.explode("images").alias("image")).where(~F.col("image").rlike("(?i)^(?:https?:|data:)") & (F.trim("image") != ""))
    shown = shown.select("case_id", F.regexp_extract(F.replace(F.col("image"), F.lit("\\"), F.lit("/")), "([^/]*)$", 1).alias("name"))
    missing = shown.join(files.select("name").distinct(), "name", "left_anti").select("case_id").distinct().withColumn("_lost", F.lit(True))
    rows = keyed.join(groups.select("_prefix", F.lit(True).alias("_twice")), "_prefix", "left").join(missing, "case_id", "left")
    # The plain forms are made once a case, behind the joins, and not again for each check and option.
    rows = rows.withColumns({"_q": best, "_r": F.trim(_text("rationale")), "_t": F.transform("options", lambda o: plain(o["text"]))})
    rows = rows.withColumns({"_pr": plain(F.col("_r")), "_pq": plain(F.col("_q"))})
    texts, n = F.col("_t"), F.coalesce(F.size("options"), F.lit(0))
    one = F.size(_right()) == 1
    key = F.when(one, F.array_position(F.transform("options", lambda o: o["is_correct"]), True) - 1)
    right = F.get(texts, key.cast("int"))
    named = _named_option(F.col("_r"), F.col("_pr"), texts)
    said = F.concat_ws(" ", F.transform("options", lambda o: o["text"]))
    source, question = F.lower(_text("source")), F.trim(F.coalesce(F.nullif("question", F.lit("")), F.col("prompt"), F.lit("")))
    labels = F.array_distinct(F.filter(F.concat(F.transform("options", lambda o: F.trim(o["id"])), F.transform("options", lambda o: F.trim(o["text"]))), lambda x: x.isin(*PANEL_LABELS)))
    panel, quoted = F.col("q_type") == "SCT", F.array_distinct(F.filter(texts, lambda t: t != ""))
    return issues(
        rows,
        "F",
        [
            ("rationale_contradicts_answer", "critical", one & named.isNotNull() & (named != key)),
            ("except_logic_suspect", "high", one & F.col("_q").rlike(NEGATIVE_QUESTION) & _affirmed(F.col("_pr"), right)),
            ("duplicate_question", "high", F.col("_twice")),
            ("encoding_broken", "high", F.concat_ws(" ", "question", "prompt", "narrative", said).rlike(ENCODING)),
            ("mixed_language", "medium", (source != "medexpqa") & F.concat_ws(" ", "_q", said, "_r").rlike(MIXED)),
            ("no_question_text", "critical", F.concat(F.trim(_text("question")), F.trim(_text("prompt")), F.trim(_text("narrative"))) == ""),
            ("no_option_text", "critical", F.size(F.filter("options", lambda o: F.trim(F.coalesce(o["text"], F.lit(""))) != "")) <= 0),
            ("question_too_short", "medium", (F.trim(_text("narrative")) == "") & F.length("_q").between(1, 14)),
            ("broken_image", "medium", F.col("_lost")),
            ("sct_missing_votes", "high", panel & (F.size(F.filter("options", lambda o: o["votes"] > 0)) < 2)),
            ("sct_wrong_option_count", "high", panel & ((n != 5) | (F.size(labels) != 5))),
            ("sct_no_rationale", "medium", panel & (F.col("_r") == "")),
            ("medexpqa_incomplete", "high", (source == "medexpqa") & ((n == 0) | F.exists("options", lambda o: F.trim(F.coalesce(o["text"], F.lit(""))) == "") | ~one | (F.length(question) <= 30))),
            ("pubmedqa_incomplete", "high", (source == "pubmedqa") & ((n != 3) | (F.array_join(F.array_sort(quoted), ",") != ",".join(YES_NO)) | ~one | ~question.endswith("?"))),
            ("all_options_same", "critical", (n > 1) & F.forall(texts, lambda t: t != "") & (F.size(F.array_distinct(texts)) == 1)),
            ("answer_in_question", "medium", one & (F.length(right) >= 8) & F.col("_pq").contains(right)),
            ("single_option", "critical", n == 1),
            ("too_many_options", "low", n > 6),
            ("no_rationale", "medium", F.col("_r").rlike(UNAVAILABLE)),
            ("rationale_too_short", "low", F.length("_r") < 10),
            ("rationale_placeholder", "low", F.col("_r").rlike(URL_ONLY) | F.col("_r").rlike(PLACEHOLDER)),
        ],
    )


def screening(df: DataFrame) -> DataFrame:
    """QA15: what gives answers away, what must not be shuffled, and what has aged; multiple-choice cases with a key."""
    wrong = F.filter("options", lambda o: ~o["is_correct"])
    right = F.coalesce(F.get(_right(), F.lit(0))["text"], F.lit(""))
    mean = F.aggregate(wrong, F.lit(0.0), lambda a, o: a + F.length(F.coalesce(o["text"], F.lit("")))) / F.greatest(F.size(wrong), F.lit(1))
    q, r = F.lower(F.coalesce(F.nullif("narrative", F.lit("")), F.col("prompt"), F.lit(""))), F.lower(_text("rationale"))
    everything = F.concat_ws(" ", q, right, F.concat_ws(" ", F.transform(wrong, lambda o: o["text"])), r)
    poison = F.exists("options", lambda o: o["text"].rlike(POISON))
    amount, unit = F.regexp_extract(q, AMOUNT, 1), F.regexp_extract(q, AMOUNT, 2)
    return issues(
        df.where((F.col("q_type") == "MCQ") & (F.size("options") >= 2) & (F.size(_right()) > 0)),
        "S",
        [
            ("length_bias", "medium", (mean > 5) & (F.length(right) > 1.8 * mean)),
            ("absolute_trap", "low", F.exists(wrong, lambda o: o["text"].rlike(ABSOLUTE))),
            ("shuffle_poison", "high", poison & ~F.coalesce("do_not_shuffle", F.lit(False))),
            ("kept_in_order", "low", poison & F.coalesce("do_not_shuffle", F.lit(False))),
            ("negation_blind", "high", q.rlike(NEGATION) & (F.length(r) > 50) & r.rlike(AFFIRMS)),
            ("withdrawn_drug", "high", everything.rlike(WITHDRAWN)),
            ("outdated_guideline", "medium", everything.rlike(OUTDATED)),
            ("unitless_glucose", "medium", q.rlike(SUGAR) & (amount != "") & (unit == "") & (F.try_to_number(amount, F.lit("999999999999D999999")) < 30)),
        ],
    )


def deep_audit(df: DataFrame) -> DataFrame:
    """QA17: fields, repeats, options, texts, panel items, explanations, exam types and images: the published fields by name."""
    full = F.trim(F.concat_ws(" ", _text("narrative"), _text("prompt")))
    low = F.trim(F.lower(_text("narrative")))
    rows = _repeats(_repeats(_repeats(df, F.col("case_id"), "_ids"), F.nullif("hash_id", F.lit("")), "_hashes"), F.when(F.length(F.substring(low, 1, 200)) > 50, F.xxhash64(F.substring(low, 1, 200))), "_texts")
    n, right = F.coalesce(F.size("options"), F.lit(0)), F.size(_right())
    mcq, panel = F.col("q_type") == "MCQ", F.col("q_type") == "SCT"
    empty = lambda c: _text(c) == ""
    r, has = _text("rationale"), F.coalesce(F.size("images"), F.lit(0)) > 0
    texts = F.transform("options", lambda o: F.lower(F.trim(F.coalesce(o["text"], F.lit("")))))
    return issues(
        rows,
        "X",
        [
            ("missing_id", "critical", F.col("case_id").isNull()),
            ("missing_qtype", "high", empty("q_type")),
            ("missing_category", "medium", empty("category")),
            ("missing_title", "low", empty("title")),
            ("missing_narrative", "medium", F.col("narrative").isNull()),
            ("empty_narrative", "medium", F.col("narrative") == ""),
            ("short_narrative", "low", mcq & F.length("narrative").between(1, 29)),
            ("missing_prompt", "medium", empty("prompt")),
            ("missing_options", "critical", n == 0),
            ("few_options", "critical", n == 1),
            ("no_correct_answer", "critical", right == 0),
            ("multiple_correct", "high", mcq & (right > 1)),
            ("missing_source", "medium", empty("source")),
            ("duplicate_ids", "critical", F.col("_ids") > 1),
            ("duplicate_hashes", "high", F.col("_hashes") > 1),
            ("duplicate_narratives", "medium", F.col("_texts") > 1),
            ("identical_options", "high", F.size(F.array_distinct(texts)) < n),
            ("option_is_empty", "high", F.exists(texts, lambda t: t == "")),
            ("very_long_option", "low", F.exists("options", lambda o: F.length(o["text"]) > 500)),
            ("narrative_has_question_stem", "low", panel & F.col("narrative").rlike(STEM)),
            ("raw_markdown_in_text", "low", full.rlike(MARKDOWN)),
            ("html_in_text", "medium", full.rlike(MARKUP)),
            ("sct_missing_hypothesis", "high", panel & empty("hypothesis") & ~_text("narrative").rlike("[Hh]ipotesis")),
            ("sct_no_panel_votes", "high", panel & ~F.coalesce(F.exists("options", lambda o: o["votes"] > 0), F.lit(False))),
            ("sct_bad_likert", "high", panel & (right == 0)),
            ("sct_english_vignette", "low", panel & F.substring(_text("narrative"), 1, 200).rlike(ENGLISH)),
            ("no_explanation", "medium", r == ""),
            ("very_short_explanation", "low", F.length(r).between(1, 19)),
            ("dirty_explanation_ans_prefix", "low", r.rlike(r"(?i)^Ans\.\s*[A-Za-z]")),
            ("dirty_explanation_ref", "low", r.rlike(r"(?i)Ref[;:]\s") | r.rlike(BOOKS)),
            ("dirty_explanation_hash_sep", "low", _count(r, "#") >= 2),
            ("dirty_explanation_image_ref", "low", r.rlike(r"(?i)\(Image\)")),
            ("dirty_explanation_extra_mile", "low", r.rlike("(?i)Extra mile")),
            ("dirty_explanation_page_ref", "low", r.rlike(r"(?i)pg\.\s*\d+")),
            ("explanation_very_long", "low", F.length(r) > 2000),
            ("auto_analysis_hallucination", "medium", F.exists(F.map_values("distractors"), lambda t: t.contains("[Auto-Analysis]"))),
            ("missing_exam_type", "low", empty("exam_type")),
            ("unknown_exam_type", "low", ~empty("exam_type") & ~F.col("exam_type").isin(*EXAM_TYPES)),
            ("phantom_image", "medium", full.rlike(PHANTOM_DEEP) & ~has),
            ("has_images", "low", has),
        ],
    )


# Local protocols: name, subject, the drug of the one school, the drug of the local one.
PROTOCOLS = [
    ("MALARIA_TX", r"\b(malaria|plasmodium|falciparum)\b", r"\b(chloroquine|atovaquone|mefloquine|malarone|quinine)\b", r"\b(DHP|dihydroartemisinin|piperaquine|primakuin|primaquine|artemisinin|ACT)\b"),
    ("TYPHOID_TX", r"\b(typhoid|salmonella typhi|enteric fever)\b", r"\b(ceftriaxone|fluoroquinolone|ciprofloxacin)\b", r"\b(chloramphenicol|kloramfenikol)\b"),
    ("TB_TX", r"\b(tuberculosis|TB|mycobacterium)\b", r"\b(RIPE|rifampin|isoniazid|pyrazinamide|ethambutol)\b", r"\b(OAT|FDC|kategori\s*[12]|2HRZE|4HR|rifampisin)\b"),
    ("DHF_TX", r"\b(dengue|DHF|DSS|hemorrhagic fever)\b", r"\b(supportive|fluid|crystalloid)\b", r"\b(RL|ringer|cairan\s*kristaloid|WHO\s*grade)\b"),
    ("RABIES_PEP", r"\b(rabies|rabid|dog\s*bite)\b", r"\b(RIG|rabies\s*immunoglobulin|HRIG)\b", r"\b(VAR|SAR|wound\s*washing)\b"),
    ("LEPTOSPIROSIS_TX", r"\b(leptospirosis|weil|leptospira|rat\s*urine|sewer)\b", r"\b(penicillin\s*g|ceftriaxone|iv\s*antibiotics)\b", r"\b(doxycycline|doksisiklin)\b"),
    ("FILARIASIS_TX", r"\b(filariasis|elephantiasis|wuchereria|brugia)\b", r"\b(ivermectin|diethylcarbamazine\s*only)\b", r"\b(albendazole)\b"),
    ("TETANUS_NEONATORUM", r"\b(tetanus neonatorum|umbilical stump|lockjaw.*neonate)\b", r"\b(metronidazole|penicillin)\b", r"\b(diazepam|ats|htig)\b"),
    ("DIPHTHERIA_TX", r"\b(diphtheria|corynebacterium|bull\s*neck)\b", r"\b(penicillin|erythromycin)\b", r"\b(ADS|anti\s*difteri\s*serum)\b"),
    ("LEPROSY_TX", r"\b(leprosy|hansen|mycobacterium\s*leprae)\b", r"\b(dapsone|rifampin)\b", r"\b(MDT|multi\s*drug|klofazimin|clofazimine)\b"),
]
# What is stabilised and referred, not operated; words of an operation; prompts that ask what to do.
REFERRED = r"\b(appendicitis|appendectomy|cholecystitis|cholecystectomy|fracture\s+(?:femur|pelvis|spine)|bowel\s*obstruction|ectopic\s*pregnancy|placenta\s*previa|intracranial\s*hemorrhage|epidural|subdural|myocardial\s*infarction|STEMI|tension\s*pneumothorax)\b"
OPERATES = r"\b(surgery|operate|surgical\s+intervention|excision|resection)\b"
ASKS = r"\b(next\s+step|management|treatment|what\s+(?:should|would))\b"
LOCAL_EXAM = "UKMPPD"


def localization(df: DataFrame, protocols: list[tuple[str, str, str, str]] = PROTOCOLS) -> DataFrame:
    """QA04: layer D, for cases of other exams than the local one: an answer or explanation with the other school's drug and not the
    local one, where the case is about the protocol's subject; an answer that operates on what is to be referred, where the prompt asks what to do."""
    answer = F.coalesce(F.get(_right(), F.lit(0))["text"], F.lit(""))
    told = F.concat_ws(" ", answer, _text("rationale"))
    everything = F.concat_ws(" ", _text("narrative"), _text("prompt"), F.concat_ws(" ", F.transform("options", lambda o: o["text"])), _text("rationale"))
    rows = df.where(~F.coalesce(F.col("exam_type") == LOCAL_EXAM, F.lit(False))).withColumns({"_all": everything, "_told": told})
    has = lambda c, p: F.col(c).rlike(f"(?i){p}")
    checks = [(name, "medium", has("_all", subject) & has("_told", other) & ~has("_told", local)) for name, subject, other, local in protocols]
    return issues(rows, "D", [*checks, ("refer_not_operate", "medium", has("_all", REFERRED) & answer.rlike(f"(?i){OPERATES}") & _text("prompt").rlike(f"(?i){ASKS}"))])
