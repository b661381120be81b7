"""The scope guard: which questions are out of scope, and which document a question names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagework.errors import EmptyMessageError, UnknownDocumentError
from passagework.functions import text as T
from passagework.registry import TOPIC_ALIASES

# Vocabulary of the guard.
CONDITION = (
    r"(?:diabet(?:es|ics|ic)|pregnan(?:t|cy)|cancer|hypertension|high blood pressure|c(?:o)?eliac|crohn(?:'s)?|allerg(?:y|ies|ic)|"
    r"intoleran(?:t|ce)|kidney disease|heart disease|gout|an(?:a)?emi(?:a|c)|asthma|arthritis|thyroid|hiv|ibs|"
    r"chest pain|stomach ache|stomachache|abdominal pain)"
)
SYMPTOM = (
    r"(?:chest pain|stomach ache|stomachache|abdominal pain|nausea|vomiting|diarrhoea|diarrhea|dizziness|dizzy|rash|migraine|headache|"
    r"shortness of breath|palpitations)"
)
NUTRIENT = (
    r"(?:proteins?|kilocalories|calories|calorie|kcals?|carbohydrates?|carbs?|sugars?|fats?|sodium|salt|fib(?:re|er)|cholesterol|"
    r"vitamins?(?:\s+[a-k])?|iron|calcium|potassium|nutrients?)"
)
MODIFIER = r"(?:saturated|trans|total|free|added|dietary)"

# Patterns of each reason, and reasons in order of precedence.
PATTERNS: dict[str, tuple[str, ...]] = {
    "medical": (
        rf"\b{SYMPTOM}\b",
        r"\b(?:medicines?|medications?|prescriptions?|prescribed|prescribe|dosage)\b",
        r"\bdiagnos(?:is|e|ed|es)\b",
        r"\bsymptoms?\b",
        r"\btreatment for\b",
        rf"\b(?:i have|i've got|i am|i'm|if i am|if i'm|if i have)\b.{{0,40}}\b{CONDITION}\b",
        rf"\b(?:can|should|may)\b.{{0,40}}\b(?:eat|eating)\b.{{0,50}}\b{CONDITION}\b",
        rf"\b(?:safe|eat|eating)\b.{{0,50}}\b{CONDITION}\b",
        rf"\b{CONDITION}\b.{{0,50}}\b(?:eat|eating|safe)\b",
    ),
    "weight_target": (
        r"\bideal weight\b",
        r"\b(?:target|goal|desired|personal) weight\b",
        r"\bweight (?:target|goal)\b",
        r"\b(?:should|do|can) (?:i|we) weigh\b",
        r"\bhow much should (?:i|we) weigh\b",
        r"\bmy weight\b",
        r"\bweigh(?:ing)? too (?:much|little)\b",
        r"\b(?:am i|are we|i am|i'm) (?:overweight|underweight)\b",
        r"\b(?:i|we) weigh\s+(?:about\s+|around\s+|over\s+|under\s+)?\d",
    ),
    "calorie_target": (
        r"\bcalor(?:ie|ies|ic)\s+deficit\b",
        r"\bdeficit\b.{0,30}\bcalor(?:ie|ies|ic)\b",
        r"\bcalor(?:ie|ies|ic)\b.{0,30}\bdeficit\b",
        r"\b(?:calorie|caloric|calories)\s+(?:goal|target|budget|allowance|surplus)\b",
        r"\bhow many (?:calories|kcals?|kilocalories) should (?:i|we)\b",
        r"\b(?:calories|kcals?|kilocalories) should (?:i|we)\b",
        r"\bmy (?:daily )?(?:calorie|caloric|calories)\b",
        r"\bpersonal calorie\b",
    ),
    "nutrient_lookup": (
        rf"\bhow (?:much|many)\s+(?:(?:grams|g|mg|kcal)\s+of\s+)?(?:{MODIFIER}\s+)?{NUTRIENT}\s+(?:is|are)\s+in\b",
        rf"\bhow (?:much|many)\s+(?:grams|g|mg|kcal)\s+of\s+(?:{MODIFIER}\s+)?{NUTRIENT}\s+(?:is\s+|are\s+)?in\b",
        rf"\b{NUTRIENT}\s+in\s+\d+(?:\.\d+)?\s*(?:kilograms?|grams?|kg|mg|g)\b",
        rf"\b{NUTRIENT}\s+(?:content|amount)\s+(?:of|in)\b",
        rf"\bhow (?:much|many)\s+(?:{MODIFIER}\s+)?{NUTRIENT}\s+(?:does|do)\b.{{0,40}}\b(?:have|contain)\b",
    ),
}
PERSONAL = ("medical", "calorie_target", "weight_target")


def _matches(folded: Column, reason: str) -> Column:
    # Unicode classes and word edges, and a dot that stops at \n alone.
    return folded.rlike("(?Ud)(?:" + "|".join(PATTERNS[reason]) + ")")


def scope_reason(message: Column) -> Column:
    """The first reason, in order of precedence, for which a message is out of scope; else null."""
    folded = T.fold(message)
    return F.coalesce(*[F.when(_matches(folded, r), F.lit(r)) for r in PATTERNS])


def alias_text(message: Column) -> Column:
    """Folded, punctuation as spaces, spaces collapsed."""
    return T.collapse(F.regexp_replace(T.fold(message), r"(?U)[^\w\s]+", " "))


def opening(text: Column, words: int) -> Column:
    """The first ``words`` words of ``alias_text``; null where there are fewer.  Only these are folded, not the whole text."""
    lead = F.regexp_extract(text, r"(?U)^\W*(?:\w+\W+){" + str(words - 1) + r"}\w+", 0)
    return F.when(lead != "", alias_text(lead))


def named_document(message: Column, documents: list[tuple[str, list[str]]]) -> Column:
    """The one document of (id, aliases) that a message names as a whole span; null for none or several.

    The registry is closed and small, so its aliases become patterns and no join is needed.
    """
    flat = alias_text(message)
    quoted = lambda a: "\\Q" + a + "\\E"
    hits = []
    for document_id, aliases in documents:
        keys = [a.lower().replace("ß", "ss") for a in aliases]
        keys = [k for k in keys if k not in TOPIC_ALIASES]
        if keys:
            hits.append(F.when(flat.rlike(r"(?U)(?<!\w)(?:" + "|".join(map(quoted, keys)) + r")(?!\w)"), F.lit(document_id)))
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")
    return F.when(F.size(found) == 1, found[0])


def named_by_table(messages: DataFrame, aliases: DataFrame, message: str = "message", most_words: int = 64) -> DataFrame:
    """``messages`` with scope_id, the one document of ``aliases`` (document_id, alias) that a message names as a whole
    span, and n_named, 0, 1 or 2 for none, one and several.  The registry may have any size: runs of words of a message meet the
    aliases in a join.

    Words are those of ``alias_text``; an alias counts if it is just that form of itself, lower case and
    single spaces, and is not in TOPIC_ALIASES.  A message that stands in many rows is looked up once.  Null
    messages and aliases name nothing.  An alias of over ``most_words`` words is an error.
    """
    folded = F.replace(F.lower("alias"), F.lit("ß"), F.lit("ss"))
    keys = aliases.select("document_id", folded.alias("run")).where("run <> '' and document_id is not null").where(~F.col("run").isin(*TOPIC_ALIASES))
    keys = keys.where(F.col("run") == alias_text(F.col("run"))).withColumn("n", F.size(F.split("run", " ")))
    # What several documents share as an alias is several whichever they are: two of them say it.
    keys = keys.groupBy("run", "n").agg(F.min("document_id").alias("low"), F.max("document_id").alias("high"))
    sizes = sorted(r.n for r in keys.select("n").distinct().limit(most_words + 1).collect())
    if sizes and (len(sizes) > most_words or sizes[-1] > most_words):
        raise ValueError(f"an alias has over {most_words} words")
    if not sizes:
        return messages.withColumn("scope_id", F.lit(None).cast(dict(aliases.dtypes)["document_id"])).withColumn("n_named", F.lit(0))
    # Each run of a message bears 96 bits of two hashes for it, not the message, which would make rows as long as it for all its words.
    flat = messages.withColumn("_flat", alias_text(F.col(message))).withColumns({"_a": F.when(F.col("_flat").isNotNull(), F.xxhash64("_flat")), "_b": F.when(F.col("_flat").isNotNull(), F.hash("_flat"))})
    words = flat.where("_flat <> ''").select("_a", "_b", "_flat").distinct().select("_a", "_b", F.split("_flat", " ").alias("w"))
    runs = [F.expr(f"if(size(w) < {n}, array(), transform(sequence(1, size(w) - {n - 1}), i -> array_join(slice(w, i, {n}), ' ')))") for n in sizes]
    met = words.select("_a", "_b", F.explode(F.array_distinct(F.concat(*runs))).alias("run")).join(keys, "run")
    named = met.groupBy("_a", "_b").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = flat.drop("_flat").join(named, ["_a", "_b"], "left").drop("_a", "_b")
    return found.withColumn("scope_id", F.when(F.col("low") == F.col("high"), F.col("low"))).withColumn("n_named", F.when(F.col("low").isNull(), 0).when(F.col("low") == F.col("high"), 1).otherwise(2)).drop("low", "high")


def question_violations(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """(query_id, rule, subject): empty messages and unknown documents."""
    flags = questions.join(F.broadcast(registry.select("document_id", F.lit(True).alias("known"))), "document_id", "left")
    empty = F.col("message").isNull() | (T.strip(F.col("message")) == "")
    unknown = F.col("document_id").isNotNull() & F.col("known").isNull()
    return flags.withColumn("rule", F.when(empty, "message is empty").when(unknown, "document_id is not in the registry")).where("rule is not null").select("query_id", "rule", F.col("document_id").alias("subject"))


def classify(questions: DataFrame, registry: DataFrame, check: bool = True) -> DataFrame:
    """``questions`` with reason and scope_id: an explicit document_id overrides one that the message names.

    With ``check``, an empty message or an unknown document stops the batch.
    """
    if check:
        bad = question_violations(questions, registry).orderBy("query_id").first()
        if bad is not None:
            if bad.rule == "message is empty":
                raise EmptyMessageError(f"query {bad.query_id}: message is empty")
            raise UnknownDocumentError(f"document_id {bad.subject} is not in the registry")
    documents = [(r.document_id, r.aliases) for r in registry.orderBy("ordinal").select("document_id", "aliases").collect()]
    return questions.withColumn("reason", scope_reason(F.col("message"))).withColumn("scope_id", F.coalesce("document_id", named_document(F.col("message"), documents)))
