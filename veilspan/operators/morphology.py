"""Lemmas and tags of word forms: known ones by table, unseen ones by the longest known ending; names found by them.

An index of endings is made from a table of forms (form, lemma, tag): for each ending of up to LONGEST letters, what it becomes in the lemma and the
tag, as most forms with it have them. An unseen word takes the longest of its endings that the index knows, which takes one join of the word's endings with the
index. Words are made distinct first, so a frequent word costs as much as a rare one, and a frequent ending is no hot key: an index of up to
BROADCAST endings is broadcast behind a count, and a larger one is joined with salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.confidence import for_morphology
from .tokens import exploded, word_of

#: Letters of an ending; letters that a word has before its ending, at least.
LONGEST, STEM = 5, 2
#: Endings (and forms) that are broadcast at most; beyond, joins shuffle, with SALT parts of each ending.
BROADCAST, SALT = 200_000, 32
#: Tags of names; tags that make a titled word a name of its own.
NAME_TAGS = ("Name", "Surn", "Patr")
PROPER = (*NAME_TAGS, "PROPN")
#: Words looked at on either side of a titled word that isn't known as a name.
NEAR = 2

#: Endings of Russian names in the cases from nominative to prepositional; the first is the lemma's.
DECLENSIONS = (
    ("Surn", "ов", "ова", "ову", "овым", "ове"), ("Surn", "ов", "ова", "овой", "ову"), ("Surn", "ев", "ева", "еву", "евым", "еве"), ("Surn", "ев", "ева", "евой", "еву"),
    ("Surn", "ин", "ина", "ину", "иным", "ине"), ("Surn", "ин", "ина", "иной", "ину"), ("Surn", "ский", "ского", "скому", "ским", "ском"), ("Surn", "ский", "ская", "ской", "скую"),
    ("Surn", "цкий", "цкого", "цкому", "цким", "цком"), ("Surn", "цкий", "цкая", "цкой", "цкую"), ("Surn", "енко"), ("Surn", "ко"), ("Surn", "их"), ("Surn", "ых"),
    ("Patr", "ович", "овича", "овичу", "овичем", "овиче"), ("Patr", "евич", "евича", "евичу", "евичем", "евиче"), ("Patr", "овна", "овны", "овне", "овну", "овной"), ("Patr", "евна", "евны", "евне", "евну", "евной"),
    ("Name", "ий", "ия", "ию", "ием", "ии"), ("Name", "ей", "ея", "ею", "еем", "ее"), ("Name", "ай", "ая", "аю", "аем", "ае"), ("Name", "ия", "ии", "ию", "ией"), ("Name", "на", "ны", "не", "ну", "ной"), ("Name", "др", "дра", "дру", "дром", "дре"), ("Name", "ан", "ана", "ану", "аном", "ане"),
)


def declension_endings(spark) -> DataFrame:
    """ending, lemma_ending, tag, weight of DECLENSIONS; where two give an ending, the one that stands first has more weight."""
    rows = [(e, d[1], d[0], len(DECLENSIONS) - i) for i, d in enumerate(DECLENSIONS) for e in d[1:]]
    return best_endings(spark.createDataFrame(rows, "ending string, lemma_ending string, tag string, weight long"))


def best_endings(endings: DataFrame) -> DataFrame:
    """One row an ending: the lemma's ending and the tag with the most weight; equal ones go by lemma_ending, then tag."""
    sums = endings.groupBy("ending", "lemma_ending", "tag").agg(F.sum("weight").alias("weight"))
    best = F.min(F.struct((-F.col("weight")).alias("w"), "lemma_ending", "tag")).alias("b")
    return sums.groupBy("ending").agg(best).select("ending", "b.lemma_ending", "b.tag", (-F.col("b.w")).alias("weight"))


def learn_endings(forms: DataFrame, longest: int = LONGEST) -> DataFrame:
    """ending, lemma_ending, tag, weight: what the endings of forms (form, lemma, tag) become, by the number of forms.

    An ending counts where what is before it, of at least STEM letters, begins the lemma too. Nulls in any column are left out; repeated rows count once.
    """
    rows = forms.select(word_of(F.col("form")).alias("form"), word_of(F.col("lemma")).alias("lemma"), "tag").na.drop().distinct()
    n = F.length("form")
    rows = rows.where(n > STEM).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(n - STEM, F.lit(longest)))))
    stem = F.substring("form", F.lit(1), n - F.col("k"))
    rows = rows.where(F.startswith("lemma", stem))
    return best_endings(rows.select(F.right("form", F.col("k")).alias("ending"), F.substring("lemma", n - F.col("k") + 1, F.length("lemma")).alias("lemma_ending"), "tag", F.lit(1).cast("long").alias("weight")))


def resolve(words: DataFrame, forms: DataFrame, endings: DataFrame) -> DataFrame:
    """word, lemma, tag, ending of the distinct words (word): every row that forms has of one, or else what its longest known ending says.

    ending is null for a known form; lemma, tag and ending are null for a word that neither table knows. Words and forms are compared in lower case with е for ё;
    null words have no row. An empty table of words gives no rows; without forms and endings all words are unknown.
    """
    words = words.select(word_of(F.col("word")).alias("word")).where("word IS NOT NULL").distinct()
    known = forms.select(word_of(F.col("form")).alias("word"), word_of(F.col("lemma")).alias("lemma"), "tag").where("word IS NOT NULL").distinct()
    seen = words.join(known, "word").withColumn("ending", F.lit(None).cast("string"))
    unseen = words.join(known.select("word").distinct(), "word", "left_anti")
    n = F.length("word")
    tails = unseen.where(n > STEM).select("word", F.explode(F.transform(F.sequence(F.lit(1), n - STEM), lambda k: F.right("word", k))).alias("ending"))
    tails = tails.join(F.broadcast(endings.agg(F.max(F.length("ending")).alias("most"))), F.length("ending") <= F.col("most")).drop("most")
    index = endings.select("ending", "lemma_ending", "tag")
    if index.count() <= BROADCAST:
        hits = tails.join(F.broadcast(index), "ending")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        hits = tails.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALT)).cast("int")).join(salted, ["ending", "salt"])
    longest = F.max_by(F.struct("ending", "lemma_ending", "tag"), F.length("ending")).alias("b")
    guessed = hits.groupBy("word").agg(longest)
    lemma = F.concat(F.substring("word", F.lit(1), F.length("word") - F.length("b.ending")), F.col("b.lemma_ending"))
    guessed = unseen.join(guessed, "word", "left").select("word", lemma.alias("lemma"), F.col("b.tag").alias("tag"), F.col("b.ending").alias("ending"))
    return seen.select("word", "lemma", "tag", "ending").unionByName(guessed)


def with_tags(rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Tokens (tokens.exploded) with the tags (array<string>) of their words; words that aren't resolved have none.

    Up to BROADCAST resolved words are broadcast; beyond, tokens and words are joined with salt, so that a frequent word isn't one task's.
    """
    tags = resolved.where("tag IS NOT NULL").groupBy("word").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    if tags.count() <= BROADCAST:
        return rows.join(F.broadcast(tags), "word", "left")
    salted = tags.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "block_id", "i"), F.lit(SALT)).cast("int")).join(salted, ["word", "salt"], "left").drop("salt")


def names(blocks: DataFrame, resolved: DataFrame, context: Sequence[str], stops: Sequence[str] = ()) -> DataFrame:
    """Detections of person_name by morphology: each titled token of two characters or more that isn't in stops and

    has a tag of a name (method morphological_enhanced), or has the tag PROPN and a context word among the NEAR tokens before or after (method morphological).
    Context words may be parts of words, in any case. ord is the token's place. Null and empty texts have none.
    """
    rows = with_tags(exploded(blocks), resolved)
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    titled = F.col("text").rlike(r"(?U)^\p{Lu}\w") & ~F.col("word").isin(*stops) if stops else F.col("text").rlike(r"(?U)^\p{Lu}\w")
    sure = F.arrays_overlap(tags, F.array(*map(F.lit, NAME_TAGS)))
    maybe = F.array_contains(tags, "PROPN")
    rows = rows.withColumns({"sure": titled & sure, "maybe": titled & maybe & ~sure})
    near = F.lit(False)
    for w in context:
        near |= F.contains("word", F.lit(w.lower().replace("ё", "е")))
    rows = rows.withColumn("near", near)
    around = Window.partitionBy("doc_id", "block_id").orderBy("i").rangeBetween(-NEAR, NEAR)
    rows = rows.where("sure OR maybe OR near").withColumn("near", F.max("near").over(around))
    found = rows.where("sure OR (maybe AND near)").withColumn("method", F.when(F.col("sure"), "morphological_enhanced").otherwise("morphological"))
    confidence = F.when(F.col("method") == "morphological", for_morphology(0.6, 1, True)).otherwise(for_morphology(0.7, 1, True))
    return found.select("doc_id", "block_id", F.lit("person_name").alias("category"), F.col("text").alias("original_value"), "start", "end", confidence.alias("confidence"), "method", F.lit("").alias("description"), F.col("i").alias("ord"))


def name_lemmas(detections: DataFrame, forms: DataFrame, endings: DataFrame) -> DataFrame:
    """form, lemma for extract.name_filter: of each word of the detections' values, the lemma with a name's tag (Surn, then Name, then Patr), else the least.

    Forms and lemmas are written like names, with a capital and е for ё.
    """
    words = detections.where("category = 'person_name'").select(F.explode(F.split("original_value", r"(?U)[^\w-]+")).alias("word")).where("word <> ''")
    found = resolve(words, forms, endings).where("lemma IS NOT NULL")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("Surn", "Name", "Patr"))), F.col("tag")), F.lit(0))
    best = F.min_by("lemma", F.struct(F.when(rank > 0, rank).otherwise(9), "lemma")).alias("lemma")
    return found.groupBy("word").agg(best).select(F.initcap("word").alias("form"), F.initcap("lemma").alias("lemma"))
