"""Raw chats, dialogues, letters and pages to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as T

#: Fixed value: what starts a tagged line of a pasted chat.
TAGGED = r"(?i)^(him|her|me|he|she|i|you|them|scammer|victim|target)\b[:\-]?\s*(.+)$"
#: Tags of the first person.
OWN_TAGS = ("me", "victim", "target", "i", "you")
#: Fixed value: speaker tags inside a dialogue.
DIALOGUE_TAG = r"(?i)\b(person\s+[ab]|suspect|innocent|scammer|victim|target|caller|receiver|user|bot)\s*[:\-]\s*"


def pasted_chat(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, turn, speaker, text: tagged lines start a message, untagged ones of more than three characters go on with it."""
    lines = df.select(id_column, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("pos", "line")).withColumn("line", T.stripped(F.col("line"))).where("line <> ''")
    tag = F.lower(F.regexp_extract("line", TAGGED, 1))
    said = T.stripped(F.regexp_extract("line", TAGGED, 2))
    tagged = lines.withColumns({"tag": tag, "said": F.when(tag != "", said).when(F.length("line") > 3, F.col("line"))})
    turn = F.sum((F.col("tag") != "").cast("int")).over(Window.partitionBy(id_column).orderBy("pos")) - 1
    held = tagged.withColumn("turn", turn).where("turn >= 0 and said is not null")
    g = held.groupBy(id_column, "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), " ").alias("text"), F.max("tag").alias("tag"))
    return g.select(id_column, "turn", F.when(F.col("tag").isin(*OWN_TAGS), "V").otherwise("S").alias("speaker"), "text")


def dialogue(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, turn, speaker, text of a dialogue whose speakers are tagged inline; what stands before the first tag and empty turns go."""
    tags = F.regexp_extract_all(F.col(text), F.lit(DIALOGUE_TAG), F.lit(1))
    pieces = F.split(F.col(text), DIALOGUE_TAG)
    turns = F.filter(F.transform(tags, lambda t, i: F.struct(T.speaker(t).alias("speaker"), T.stripped(F.get(pieces, i + 1)).alias("text"))), lambda x: x["text"] != "")
    return df.select(id_column, F.posexplode(turns).alias("turn", "t")).select(id_column, "turn", "t.speaker", "t.text")


def of_length(turns: DataFrame, id_column: str, least: int = 4) -> DataFrame:
    """The turns of conversations that have `least` of them or more (4 of dialogues, 6 of forum posts)."""
    return turns.join(turns.groupBy(id_column).count().where(F.col("count") >= least).select(id_column), id_column, "left_semi")


def dialogue_column(columns: list[str], candidates=("dialogue", "conversation", "text", "content"), least: int = 20) -> Column:
    """The first non-empty candidate, else the longest text over `least` characters."""
    named = [F.when(F.col(c) != "", F.col(c)) for c in candidates if c in columns]
    longest = F.array_max(F.filter(F.array(*[F.struct(F.length(c).alias("n"), F.col(c).alias("t")) for c in columns]), lambda x: x["n"] > least))["t"]
    return F.coalesce(*named, longest)


def letter_messages(df: DataFrame, id_column: str, text: str, group: int = 3, least: int = 15) -> DataFrame:
    """id, turn, text: three sentences a message; short ones go."""
    sents = T.sentences(F.col(text), "stripped")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(sents) - 1), F.lit(group)), lambda i: i < F.size(sents))
    messages = F.filter(F.transform(starts, lambda i: F.array_join(F.slice(sents, i + 1, F.lit(group)), " ")), lambda m: F.length(m) > least)
    return df.select(id_column, F.posexplode(messages).alias("turn", "text"))


def page_links(df: DataFrame, id_column: str, url: str, html: str) -> DataFrame:
    """id, ord, link: absolute addresses of a page's links, each once, in order of first appearance."""
    hrefs = F.filter(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<a\b[^>]*?href=\"([^\"]+)\""), F.lit(1)), lambda h: ~h.startswith("javascript"))
    links = F.array_distinct(F.transform(hrefs, lambda h: T.absolute_url(F.col(url), h)))
    return df.select(id_column, F.posexplode(links).alias("ord", "link"))


def page_article(df: DataFrame, id_column: str, html: str, least: int = 40) -> DataFrame:
    """id, title and text (tags off, white space single) of pages with enough words."""
    title = T.stripped(F.regexp_extract(F.col(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    body = F.regexp_replace(F.regexp_extract(F.col(html), r"(?is)<article[^>]*>(.*)</article>", 1), r"(?s)<[^>]*>", " ")
    out = df.select(id_column, title.alias("title"), T.stripped(F.regexp_replace(body, r"\s+", " ")).alias("text"))
    return out.where(T.n_words(F.col("text")) >= least)


def question_answers(df: DataFrame, id_column: str, human: str, machine: str, most_each: int, seed: int = 0) -> DataFrame:
    """id, text, label from lists of answers of people (0) and machines (1): cut to whole sentences, shuffled by a seeded hash, at most 2 * most_each."""
    one = lambda c, y: df.select(id_column, F.posexplode(c).alias("k", "text"), F.lit(y).alias("label"))
    both = one(human, 0).unionByName(one(machine, 1)).withColumn("text", T.truncated(F.col("text"))).where("text is not null")
    return both.orderBy(F.xxhash64(F.lit(seed), id_column, "label", "k"), id_column, "label", "k").limit(2 * most_each).select(id_column, "text", "label")


def inferred_label(column: Column | None, split: Column, dataset: Column) -> Column:
    """1 for a scam, 0 for none: from the label column (a number, or a word), else from the split's name, else from the data set's name."""
    name = F.lower(split)
    by_split = F.when(name.contains("scam") & ~name.contains("no"), 1).when(name.contains("no") | name.contains("benign"), 0)  # "normal" has "no" in it
    told = F.coalesce(by_split, F.lower(dataset).contains("scam").cast("int"))
    if column is None:
        return told
    word = F.lower(column.cast("string"))
    number = F.when(word.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(word).cast("int"))
    return F.when(column.isNotNull(), F.coalesce(number, word.rlike("^(?:scam|1|true)").cast("int"))).otherwise(told)
