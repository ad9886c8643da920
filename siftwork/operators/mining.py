"""Template mining: logs by position, JSON by key, prose by frequent n-grams.

Every function takes a DataFrame with a key column (the source: a file, a document) and works on all sources at once.
Frequencies are aggregations with map-side combination; what a line needs of its source (static positions, frequent
n-grams) comes back by an equi-join on the source or on the source and the position, which AQE splits where a source is
hot. Examples are taken by order, not by arrival, so results don't depend on partitions.

Defined cases: null lines are left out, blank ones have no tokens and the empty pattern; a source without lines has no
templates; ties in order go to the smaller pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from siftwork.config import Config
from siftwork.functions import onetext as O
from siftwork.functions import shapes as S
from siftwork.functions import text as X

DEFAULT = Config()


def positional_frequency(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, pos (from 0), token, n: how often each token is at each position."""
    own = lines.where(F.col(line).isNotNull()).select(F.col(key).alias("key"), F.posexplode(X.tokens(F.col(line))).alias("pos", "token"))
    return own.groupBy("key", "pos", "token").agg(F.count(F.lit(1)).alias("n"))


def static_positions(frequency: DataFrame, line_counts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """key, pos, token of the positions that hold one token only, in enough of the source's lines."""
    one = frequency.groupBy("key", "pos").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("n"), F.max("token").alias("token"))
    enough = F.col("n") >= F.floor(F.col("line_count") * config.static_threshold)
    return one.where("kinds = 1").join(line_counts, "key").where(enough).select("key", "pos", "token")


def log_patterns(lines: DataFrame, key: str, line: str, order: str, config: Config = DEFAULT) -> DataFrame:
    """key, ord, tokens and pattern of each line: static tokens as they are, [POS_nn] elsewhere.

    The static tokens of a source are one map, at most as long as its longest line, joined to its lines by the source.
    """
    own = lines.where(F.col(line).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(line).alias("line"))
    counts = own.groupBy("key").agg(F.count(F.lit(1)).alias("line_count"))
    static = static_positions(positional_frequency(own, "key", "line"), counts, config)
    maps = static.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "token"))).alias("static"))
    tok = own.join(maps, "key", "left").select("key", "ord", X.tokens(F.col("line")).alias("tokens"), "static")
    part = F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at("static", i), X.placeholder("POS", i)))
    return tok.select("key", "ord", "tokens", F.array_join(part, " ").alias("pattern"))


def log_templates(lines: DataFrame, key: str, line: str, order: str, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, template_count of each source."""
    return log_patterns(lines, key, line, order, config).groupBy("key", "pattern").agg(F.count(F.lit(1)).alias("template_count"))


def log_examples(lines: DataFrame, key: str, line: str, order: str, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, placeholder, example_no, example: the first distinct tokens at each open position, over the first
    lines of each template."""
    p = log_patterns(lines, key, line, order, config)
    first = W.partitionBy("key", "pattern").orderBy("ord", "tokens")
    p = p.withColumn("k", F.row_number().over(first)).where(F.col("k") <= config.max_sample_lines)
    each = p.select("key", "pattern", "k", F.posexplode("tokens").alias("pos", "example"), F.split("pattern", " ").alias("parts"))
    each = each.where(F.get("parts", F.col("pos")) == X.placeholder("POS", F.col("pos")))
    seen = each.groupBy("key", "pattern", "pos", "example").agg(F.min("k").alias("k"))
    seen = seen.withColumn("example_no", F.row_number().over(W.partitionBy("key", "pattern", "pos").orderBy("k")))
    return seen.where(F.col("example_no") <= config.max_examples_per_placeholder).select("key", "pattern", F.format_string("POS_%02d", F.col("pos")).alias("placeholder"), "example_no", "example")


def json_pairs(records: DataFrame, key: str, record: str, order: str) -> DataFrame:
    """key, ord, is_array, place, jkey, kind, value, shown, example: the fields of each JSON object or array, parsed once.

    value is the text that a field's frequency is counted by: text in quotes, numbers, booleans and null as they stand,
    [kind:length] for arrays, {n keys} for objects. shown is the text of patterns, with [n items] for arrays; example is text
    without quotes. The items of an array are named by its place, or by the names in a column ``headers``, where there is
    one and it isn't null.
    """
    header = F.col("headers") if "headers" in records.columns else F.lit(None).cast("array<string>")
    own = records.where(F.col(record).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("ord"), F.try_parse_json(F.col(record)).alias("v"), header.alias("headers"))
    named = F.map_entries(F.try_variant_get("v", F.lit("$"), "map<string,variant>"))
    placed = F.try_variant_get("v", F.lit("$"), "array<variant>")
    name = lambda i: F.when(F.col("headers").isNull(), F.format_string("pos_%02d", i)).otherwise(F.coalesce(F.get("headers", i), F.format_string("col_%02d", i)))
    each = F.coalesce(named, F.transform(placed, lambda x, i: F.struct(name(i).alias("key"), x.alias("value"))))
    own = own.select("key", "ord", placed.isNotNull().alias("is_array"), F.posexplode(each).alias("place", "e"))
    own = own.select("key", "ord", "is_array", "place", F.col("e.key").alias("jkey"), F.to_json(F.col("e.value")).alias("raw"), F.try_variant_get("e.value", F.lit("$"), "string").alias("s"))
    c = F.substring("raw", 1, 1)
    of = lambda c: F.when(c == '"', "str").when(c == "[", "array").when(c == "{", "object").when(c.isin("t", "f"), "bool").when(c == "n", "null").otherwise("num")
    n = F.json_array_length("raw")
    inner = F.substring(F.ltrim(F.substring(F.col("raw"), F.lit(2), F.length("raw"))), 1, 1)
    short = F.when(of(inner) == "array", "arr").when(of(inner) == "object", "obj").otherwise(of(inner))
    kind, keys = of(c), F.size(F.json_object_keys("raw"))
    plain = F.when(kind == "str", F.concat(F.lit('"'), "s", F.lit('"'))).when(kind == "object", F.when(keys == 0, "{}").otherwise(F.format_string("{%d keys}", keys))).otherwise(F.col("raw"))
    value = F.when(kind == "array", F.when(n == 0, "[]").otherwise(F.format_string("[%s:%d]", short, n))).otherwise(plain)
    shown = F.when(kind == "array", F.when(n == 0, "[]").otherwise(F.format_string("[%d items]", n))).otherwise(plain)
    example = F.when(kind == "str", F.col("s")).otherwise(F.col("raw"))
    return own.select("key", "ord", "is_array", "place", "jkey", kind.alias("kind"), value.alias("value"), shown.alias("shown"), example.alias("example"))


def _json_rows(records: DataFrame, key: str, record: str, order: str) -> DataFrame:
    """key, ord, doc of the records that are JSON."""
    own = records.where(F.col(record).isNotNull() & F.try_parse_json(F.col(record)).isNotNull())
    return own.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.ltrim(record).alias("doc"))


def json_patterns(records: DataFrame, key: str, record: str, order: str, config: Config = DEFAULT) -> DataFrame:
    """key, ord, pattern: records with fields of frequent values as they are and [VALUE] elsewhere; objects by name, arrays
    by place; a scalar, an empty object and an empty array are patterns of their own.

    A static value fills most records of its source, so values aren't joined to it by themselves: the static values of a
    source come as one map, bounded by its fields, to each of its records.
    """
    rows = _json_rows(records, key, record, order)
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_records"))
    pairs = json_pairs(records, key, record, order)
    freq = pairs.groupBy("key", "jkey", "value").agg(F.count(F.lit(1)).alias("n"))
    static = freq.join(size, "key").where(F.col("n") >= F.floor(F.col("n_records") * config.static_threshold))
    # at thresholds above one half a field has one static value; lower ones may have some more
    maps = static.groupBy("key").agg(F.collect_set(F.struct("jkey", "value")).alias("static"))
    field = F.struct("place", "jkey", "value", "shown")
    whole = pairs.groupBy("key", "ord", "is_array").agg(F.collect_list(field).alias("f"))  # the fields of one record
    whole = whole.join(maps, "key", "left")
    known = lambda f: F.coalesce(F.array_contains("static", F.struct(f["jkey"].alias("jkey"), f["value"].alias("value"))), F.lit(False))
    part = lambda f: F.concat(F.lit('"'), f["jkey"], F.lit('": '), F.when(known(f), f["shown"]).otherwise("[VALUE]"))
    by_name = F.array_sort(F.transform("f", lambda f: F.struct(f["jkey"].alias("o"), part(f).alias("p"))))
    by_place = F.array_sort(F.transform("f", lambda f: F.struct(f["place"].alias("o"), part(f).alias("p"))))
    body = lambda a: F.array_join(F.transform(a, lambda x: x["p"]), ", ")
    shown = F.when(F.col("is_array"), F.concat(F.lit("["), body(by_place), F.lit("]"))).otherwise(F.concat(F.lit("{"), body(by_name), F.lit("}")))
    whole = whole.select("key", "ord", shown.alias("pattern"))
    bare = F.when(F.col("doc").startswith("{"), F.when(F.size(F.json_object_keys("doc")) == 0, "{}")).when(F.col("doc").startswith("["), F.when(F.json_array_length("doc") == 0, "[]")).otherwise("[VALUE]")
    return whole.unionByName(rows.select("key", "ord", bare.alias("pattern")).where("pattern is not null"))


def json_templates(records: DataFrame, key: str, record: str, order: str, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, template_count of each source."""
    return json_patterns(records, key, record, order, config).groupBy("key", "pattern").agg(F.count(F.lit(1)).alias("template_count"))


def json_examples(records: DataFrame, key: str, record: str, order: str, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, placeholder, example_no, example: the first distinct values of each field, static ones too, over the
    first records of each template; those of scalars under VALUE."""
    p = json_patterns(records, key, record, order, config)
    p = p.withColumn("k", F.row_number().over(W.partitionBy("key", "pattern").orderBy("ord"))).where(F.col("k") <= config.max_sample_lines)
    each = json_pairs(records, key, record, order).select("key", "ord", F.concat("jkey", F.lit("_VALUE")).alias("placeholder"), "example")
    rows = _json_rows(records, key, record, order).where(~F.col("doc").startswith("{") & ~F.col("doc").startswith("["))
    scalar = F.coalesce(F.when(F.col("doc").startswith('"'), F.try_variant_get(F.try_parse_json("doc"), F.lit("$"), "string")), F.to_json(F.try_parse_json("doc")))
    each = each.unionByName(rows.select("key", "ord", F.lit("VALUE").alias("placeholder"), scalar.alias("example"))).join(p, ["key", "ord"])
    seen = each.groupBy("key", "pattern", "placeholder", "example").agg(F.min("k").alias("k"))
    seen = seen.withColumn("example_no", F.row_number().over(W.partitionBy("key", "pattern", "placeholder").orderBy("k", "example")))
    return seen.where(F.col("example_no") <= config.max_examples_per_placeholder).select("key", "pattern", "placeholder", "example_no", "example")


def ngram_counts(sentences: DataFrame, key: str, tokens: str, config: Config = DEFAULT) -> DataFrame:
    """key, ngram, n over all sentences (occurrences, not sentences)."""
    grams = X.ngrams(F.col(tokens), config.min_ngram_size, config.max_ngram_size)
    return sentences.select(F.col(key).alias("key"), F.explode(grams).alias("ngram")).groupBy("key", "ngram").agg(F.count(F.lit(1)).alias("n"))


def frequent_ngrams(counts: DataFrame, sizes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The counts that reach the threshold of their source's sentences; below a hundred sentences all do."""
    return counts.join(sizes, "key").where(F.col("n") >= F.floor(F.col("n_sentences") * config.text_threshold)).drop("n_sentences")


def sentence_table(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, sent_no, sentence, tokens."""
    own = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.posexplode(X.sentences(F.col(text))).alias("sent_no", "sentence"))
    return own.withColumn("tokens", X.tokens(F.col("sentence")))


def successors(sentences: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, pos, word, next: each normalised word with the one behind it, null at the end or where that has no letter or digit."""
    own = sentences.select(F.col(key).alias("key"), F.transform(tokens, lambda t: X.normal_token(t)).alias("w"))
    each = own.select("key", "w", F.posexplode("w").alias("pos", "word")).where("word <> ''")
    nxt = F.get("w", F.col("pos") + 1)
    return each.select("key", "pos", "word", F.when(nxt != "", nxt).alias("next"))


def pivots(sentences: DataFrame, key: str, tokens: str, config: Config = DEFAULT) -> DataFrame:
    """key, pos, word, n, variation: frequent words at a position that are followed by several different words."""
    sizes = sentences.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n_sentences"))
    each = successors(sentences, key, tokens)
    # two steps: pairs first, so that a frequent word's successors are combined before they meet
    step = each.groupBy("key", "pos", "word", "next").agg(F.count(F.lit(1)).alias("n"))
    got = step.groupBy("key", "pos", "word").agg(F.sum("n").alias("n"), F.count("next").alias("variation"))
    least = F.floor(F.greatest(F.col("n_sentences") * config.text_threshold, F.lit(2.0)))
    ok = (F.col("n") >= least) & F.col("variation").between(config.min_pivot_variation, config.max_pivot_variation)
    return got.join(sizes, "key").where(ok).select("key", "pos", "word", "n", "variation")


def svo(sentences: DataFrame, key: str, order: str, tokens: str, config: Config = DEFAULT) -> DataFrame:
    """key with the share of sentences that have a pivot, and the mean words before and after their first one."""
    own = sentences.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(tokens).alias("tok"))
    each = own.select("key", "ord", F.size("tok").alias("len"), F.posexplode(F.transform("tok", lambda t: X.normal_token(t))).alias("pos", "word"))
    hit = each.join(pivots(own, "key", "tok", config).select("key", "pos", "word"), ["key", "pos", "word"], "left_semi")
    first = hit.groupBy("key", "ord").agg(F.min("pos").alias("pos"), F.max("len").alias("len"))
    after = F.col("len") - F.col("pos") - 1
    stats = first.groupBy("key").agg(
        F.count(F.lit(1)).alias("with_pivot"),
        F.coalesce(F.avg(F.when(F.col("pos") > 0, F.col("pos"))), F.lit(0.0)).alias("avg_subject_length"),
        F.coalesce(F.avg(F.when(after > 0, after)), F.lit(0.0)).alias("avg_object_length"),
    )
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n_sentences"))
    out = sizes.join(stats, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return out.select("key", "n_sentences", (100.0 * F.coalesce(F.col("with_pivot"), F.lit(0)) / F.col("n_sentences")).alias("svo_structure_percent"), zero("avg_subject_length"), zero("avg_object_length"))


def top_pivots(found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The most frequent pivots of each source: a report of max_common_pivots rows."""
    k = F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "pos", "word"))
    return found.withColumn("rank", k).where(F.col("rank") <= config.max_common_pivots)


def footprint(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Writing footprint of each document: distinct over all words, and words and punctuation of its full sentences."""
    own = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    trim = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"
    words = F.filter(F.transform(X.tokens(F.col("text")), lambda t: F.regexp_replace(t, trim, "")), lambda t: t != "")
    d = own.select("key", words.alias("w"), F.filter(X.sentences(F.col("text")), lambda s: X.is_full_sentence(s)).alias("s"))
    n = F.size("s")
    total = lambda f: F.aggregate(F.transform("s", f), F.lit(0), lambda a, x: a + x)
    share = lambda cond: F.when(n > 0, 100.0 * F.size(F.filter("s", cond)) / n).otherwise(0.0)
    mean = lambda f: F.when(n > 0, total(f) / n).otherwise(0.0)
    return d.select(
        "key",
        F.when(F.size("w") > 0, F.size(F.array_distinct("w")) / F.size("w")).otherwise(0.0).alias("vocabulary_richness"),
        mean(lambda s: F.size(X.tokens(s))).alias("avg_sentence_length"),
        share(lambda s: F.rtrim(s).endswith(".")).alias("period_percent"),
        share(lambda s: F.rtrim(s).endswith("?")).alias("question_percent"),
        share(lambda s: F.rtrim(s).endswith("!")).alias("exclamation_percent"),
        share(lambda s: s.contains('"') | s.contains("'")).alias("dialogue_percent"),
        mean(lambda s: F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))).alias("avg_commas_per_sentence"),
    )


def text_patterns(documents: DataFrame, key: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """key, sent_no, tokens, pattern of each full sentence: frequent n-grams as they are, [WORD_i] elsewhere."""
    s = sentence_table(documents, key, text).where(X.is_full_sentence(F.col("sentence")))
    sizes = s.groupBy("key").agg(F.count(F.lit(1)).alias("n_sentences"))
    frequent = frequent_ngrams(ngram_counts(s, "key", "tokens", config), sizes, config)
    # only n-grams of the sentence itself matter to it, so each sentence gets those of its own that are frequent
    own = s.select("key", "sent_no", "tokens", F.explode(F.array_distinct(X.ngrams(F.col("tokens"), config.min_ngram_size, config.max_ngram_size))).alias("ngram"))
    hits = own.join(frequent.select("key", "ngram"), ["key", "ngram"]).groupBy("key", "sent_no").agg(F.collect_list("ngram").alias("frequent"))
    none = F.array().cast("array<string>")
    j = s.join(hits, ["key", "sent_no"], "left").select("key", "sent_no", "tokens", F.coalesce("frequent", none).alias("frequent"))
    return j.select("key", "sent_no", "tokens", X.greedy_pattern(F.col("tokens"), F.col("frequent"), config.min_ngram_size, config.max_ngram_size).alias("pattern"))


#: Bytes up to which a document is mined in one pass by one task; its templates depend on nothing outside it.
LOCAL = 4 << 20


def text_templates(documents: DataFrame, key: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, template_count, fallback, examples: templates of each document's full sentences, with examples by
    placeholder and with the entropy behind the pattern where it is shown; where no pattern repeats, sentences are grouped by
    their number of words instead (fallback).

    Documents up to LOCAL bytes are mined where they are read, in one pass; larger ones are spread by sentence and n-gram
    (`templates_with_examples`). Both give the same templates.
    """
    own = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = f"key {dict(documents.dtypes)[key]}, pattern string, template_count bigint, fallback boolean, examples map<string,array<string>>"

    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                rows += [{"key": k, "pattern": p, "template_count": n, "fallback": f, "examples": list(e.items())} for p, n, e, f in O.mine_text(t, config)[0]]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    wide = F.octet_length("text") > LOCAL
    large = own.where(wide).repartition("key")  # one exchange for all that read it
    return own.where(~wide).mapInArrow(run, out).unionByName(templates_with_examples(large, "key", "text", config))


def example_counts(examples: DataFrame, keys: list[str], config: Config = DEFAULT) -> DataFrame:
    """keys and examples: distinct examples, five a placeholder at most."""
    each = examples.groupBy(*keys, "placeholder").agg(F.least(F.countDistinct("example"), F.lit(min(config.max_examples_per_placeholder, 5))).alias("n"))
    return each.groupBy(*keys).agg(F.sum("n").alias("examples"))


def templates_with_examples(documents: DataFrame, key: str, text: str, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, template_count, fallback, examples: `text_templates` with the examples that the first sentences of each
    give, by placeholder, and with the entropy behind the pattern where it is shown.

    Patterns of placeholders only have examples at each token with a letter or digit, others at their placeholders. The
    patterns are dear, so they are made once and dealt out by document, and all counts are windows over them.
    """
    p = text_patterns(documents, key, text, config).repartition("key")
    doc, shape = W.partitionBy("key"), F.array_join(F.transform("tokens", lambda t, i: X.placeholder("WORD", i)), " ")
    one = F.lit(1)
    p = p.withColumn("n_sentences", F.count(one).over(doc)).withColumn("avg_len", F.avg(F.size("tokens")).over(doc)).withColumn("len", F.size("tokens"))
    p = p.withColumn("exact_count", F.count(one).over(W.partitionBy("key", "pattern"))).withColumn("coarse_count", F.count(one).over(W.partitionBy("key", "len")))
    least = F.greatest(F.floor(F.col("n_sentences") * config.text_threshold), F.lit(2))
    longest = 2 * F.floor("avg_len")
    p = p.withColumn("exact", (F.col("exact_count") >= least) & (F.size(F.split("pattern", " ")) <= longest)).withColumn("fallback", ~F.max("exact").over(doc))
    p = p.where(F.when(F.col("fallback"), (F.col("coarse_count") >= least) & (F.col("len") <= longest)).otherwise(F.col("exact")))
    p = p.select("key", "sent_no", "tokens", "fallback", F.when(F.col("fallback"), shape).otherwise(F.col("pattern")).alias("pattern"), F.when(F.col("fallback"), F.col("coarse_count")).otherwise(F.col("exact_count")).alias("template_count"))
    most = min(max(config.max_examples_per_placeholder // 2, config.min_examples_per_placeholder), config.max_examples_for_entropy)
    first = p.withColumn("k", F.row_number().over(W.partitionBy("key", "pattern").orderBy("sent_no"))).where(F.col("k") <= most)
    t = first.groupBy("key", "pattern", "template_count", "fallback").agg(F.collect_list("tokens").alias("some"))  # at most `most` sentences
    open_ = S.all_placeholders(F.col("pattern"))
    places = F.transform(F.regexp_extract_all("pattern", F.lit(r"(?:^| )\[WORD_(\d+)\](?= |$)"), F.lit(1)), lambda x: x.cast("int"))
    places = F.when(open_, F.sequence(F.lit(0), F.size(F.col("some")[0]) - 1)).otherwise(places)
    worth = lambda x: x.isNotNull() & (~open_ | x.rlike(r"[\p{IsAlphabetic}\p{N}]"))
    # a pattern numbers its placeholders by token, its examples are numbered in sequence; for open patterns both are the same
    lists = F.transform(places, lambda i, k: F.struct(F.format_string("WORD_%02d", F.when(open_, i).otherwise(k)).alias("key"), F.array_distinct(F.filter(F.transform("some", lambda t: F.get(t, i)), worth)).alias("value")))
    t = t.withColumn("examples", F.map_from_entries(F.filter(lists, lambda x: F.size(x["value"]) > 0)))
    t = t.withColumn("n", F.transform(F.map_values("examples"), lambda x: F.size(x)))
    bound = F.lit(float(config.entropy_small_sample_threshold))
    entropy_ = F.aggregate("n", F.lit(0.0), lambda a, n: a + F.when(n <= 1, 0.0).otherwise(F.least(n / bound, F.lit(1.0)))) / F.size("n")
    t = t.withColumn("entropy", F.when(F.size("n") > 0, entropy_).otherwise(0.0))
    shown = (F.col("template_count") >= config.min_entropy_sample_size) & (F.col("entropy") > config.min_entropy_display) & (F.col("entropy") < config.max_entropy_display)
    tagged = F.when(shown, F.format_string("%s [entropy=%.2f]", "pattern", F.bround("entropy", 2))).otherwise(F.col("pattern"))
    return t.select("key", tagged.alias("pattern"), "template_count", "fallback", "examples")


def pattern_tokens(pattern: Column) -> Column:
    return F.size(F.filter(F.split(pattern, r"\s+"), lambda t: t != ""))


def example_total(examples: Column, config: Config = DEFAULT) -> Column:
    """Examples of a template, five a placeholder at most."""
    return F.aggregate(F.map_values(examples), F.lit(0), lambda a, x: a + F.least(F.size(x), F.lit(min(config.max_examples_per_placeholder, 5))))


def common_pivots(sentences: DataFrame, key: str, order: str, tokens: str, config: Config = DEFAULT) -> DataFrame:
    """key and common_pivots: the words that are most often the first pivot of a sentence, max_common_pivots at most."""
    own = sentences.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(tokens).alias("tok"))
    each = own.select("key", "ord", F.posexplode(F.transform("tok", lambda t: X.normal_token(t))).alias("pos", "word"))
    hit = each.join(pivots(own, "key", "tok", config).select("key", "pos", "word"), ["key", "pos", "word"], "left_semi")
    first = hit.groupBy("key", "ord").agg(F.min(F.struct("pos", "word"))["word"].alias("word"))
    n = first.groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("k", F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "word"))).where(F.col("k") <= config.max_common_pivots)
    return top.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("common_pivots"))


def compression(templates: DataFrame, originals: DataFrame, config: Config = DEFAULT, footprints: DataFrame | None = None) -> DataFrame:
    """key, original_tokens, compressed_tokens, reduction_percent.

    templates: key, pattern and, if there are any, examples (number of examples, capped at five each placeholder).
    originals: key, original_tokens. footprints, for text: key, footprint_tokens; a key without one wasn't mined, and has
    no compressed tokens and no reduction.
    """
    examples = F.coalesce(F.col("examples"), F.lit(0)) if "examples" in templates.columns else F.lit(0)
    used = templates.groupBy("key").agg(F.sum(pattern_tokens(F.col("pattern")) + examples).alias("t"))
    own = originals.join(used, "key", "left")
    total = F.coalesce("t", F.lit(0)) + config.json_overhead_tokens
    mined = F.lit(True)
    if footprints is not None:
        own = own.join(footprints, "key", "left")
        mined = F.col("footprint_tokens").isNotNull()
        total = F.when(mined, total + F.col("footprint_tokens")).otherwise(0)
    out = own.withColumn("compressed_tokens", total)
    saved = F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0))
    return out.select("key", "original_tokens", "compressed_tokens", F.when(mined & (F.col("original_tokens") > 0), 100.0 * saved / F.col("original_tokens")).otherwise(0.0).alias("reduction_percent"))


def line_stats(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, byte_count, line_count, line_ending, max_line_length (bytes), blank_line_count."""
    t = F.col(text)
    d = documents.where(t.isNotNull()).select(F.col(key).alias("key"), t.alias("text"), X.lines(t).alias("ls"))
    return d.select(
        "key",
        F.octet_length("text").alias("byte_count"),
        F.size("ls").alias("line_count"),
        X.line_ending(F.col("text")).alias("line_ending"),
        F.coalesce(F.array_max(F.transform("ls", lambda x: F.octet_length(x))), F.lit(0)).alias("max_line_length"),
        F.size(F.filter("ls", lambda x: x.rlike(r"(?U)^\s*$"))).alias("blank_line_count"),
    )


def entropy(examples: DataFrame, keys: list[str], config: Config = DEFAULT) -> DataFrame:
    """keys and entropy: mean over placeholders of 0 for one example, else examples / 5, 1 at most.

    Examples are distinct, so their entropy is that of a uniform choice, normalised, times the reliability of the sample.
    """
    n = F.least(F.col("n"), F.lit(config.max_examples_for_entropy))
    each = examples.groupBy(*keys, "placeholder").agg(F.countDistinct("example").alias("n"))
    one = F.when(n <= 1, 0.0).otherwise(F.least(n / float(config.entropy_small_sample_threshold), F.lit(1.0)))
    return each.groupBy(*keys).agg(F.avg(one).alias("entropy"))


def delimiter_vote(files: DataFrame, key: str, text: str) -> DataFrame:
    """key and the most frequent of , ; tab | : in the first five lines; ties go to the earlier one, comma if none occurs."""
    head = F.array_join(F.slice(X.lines(F.col(text)), 1, 5), "\n")
    marks = (",", ";", "\t", "|", ":")
    counted: list[Column] = [F.struct((F.length(head) - F.length(F.replace(head, F.lit(m), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(marks)]
    return files.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.array_max(F.array(*counted))["m"].alias("delimiter"))


def position_examples(patterns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, placeholder, example_no, example for patterns of placeholders only: the first distinct tokens at each
    position, in the order of the sentences. patterns: key, pattern, sent_no, tokens."""
    limit = max(config.max_examples_per_placeholder // 2, config.min_examples_per_placeholder)
    each = patterns.select("key", "pattern", "sent_no", F.posexplode("tokens").alias("pos", "example"))
    seen = each.groupBy("key", "pattern", "pos", "example").agg(F.min("sent_no").alias("sent_no"))
    k = F.row_number().over(W.partitionBy("key", "pattern", "pos").orderBy("sent_no", "example"))
    seen = seen.withColumn("example_no", k).where(F.col("example_no") <= limit)
    return seen.select("key", "pattern", F.format_string("WORD_%02d", F.col("pos")).alias("placeholder"), "example_no", "example")


def structural_patterns(sentences: DataFrame, key: str, order: str, tokens: str, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, n: sentences with pivots kept and other words numbered in sequence."""
    own = sentences.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(tokens).alias("tok"))
    each = own.select("key", "ord", F.posexplode("tok").alias("pos", "token")).withColumn("word", X.normal_token(F.col("token")))
    hit = pivots(own, "key", "tok", config).select("key", "pos", "word", F.lit(True).alias("pivot"))
    marked = each.join(hit, ["key", "pos", "word"], "left").groupBy("key", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "token", "pivot"))).alias("parts"))  # the words of one sentence
    start = F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("o"))

    def step(acc: Column, p: Column) -> Column:
        kept = F.struct(acc["k"].alias("k"), F.concat(acc["o"], F.array(p["token"])).alias("o"))
        open_ = F.struct((acc["k"] + 1).alias("k"), F.concat(acc["o"], F.array(X.placeholder("WORD", acc["k"]))).alias("o"))
        return F.when(p["pivot"], kept).otherwise(open_)

    shown = marked.select("key", F.array_join(F.aggregate("parts", start, step)["o"], " ").alias("pattern"))
    return shown.groupBy("key", "pattern").agg(F.count(F.lit(1)).alias("n"))


def sentence_structures(sentences: DataFrame, key: str, sentence: str, config: Config = DEFAULT) -> DataFrame:
    """key, structure, n: number of words and end of the sentences, where they reach the threshold of their source."""
    s = sentences.select(F.col(key).alias("key"), F.format_string("words=%d,end=%s", F.size(X.tokens(F.col(sentence))), X.end_type(F.col(sentence))).alias("structure"))
    sizes = s.groupBy("key").agg(F.count(F.lit(1)).alias("n_sentences"))
    got = s.groupBy("key", "structure").agg(F.count(F.lit(1)).alias("n"))
    return got.join(sizes, "key").where(F.col("n") >= F.floor(F.col("n_sentences") * config.text_threshold)).drop("n_sentences")


def ngram_examples(patterns: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """key, pattern, placeholder, example_no, example of patterns with frequent n-grams, over the first sentences of each.

    A pattern numbers its placeholders by token, examples number them in sequence: the k-th placeholder's number is the
    token that its example is. patterns: key, sent_no, tokens, pattern, as `text_patterns` gives them.
    """
    limit = max(config.max_examples_per_placeholder // 2, config.min_examples_per_placeholder)
    first = F.row_number().over(W.partitionBy("key", "pattern").orderBy("sent_no"))
    own = patterns.withColumn("k", first).where(F.col("k") <= min(limit, config.max_examples_for_entropy))
    places = F.regexp_extract_all("pattern", F.lit(r"(?:^| )\[WORD_(\d+)\](?= |$)"), F.lit(1))
    each = own.select("key", "pattern", "sent_no", "tokens", F.posexplode(places).alias("seq", "place"))
    each = each.select("key", "pattern", "sent_no", "seq", F.get("tokens", F.col("place").cast("int")).alias("example"))
    seen = each.groupBy("key", "pattern", "seq", "example").agg(F.min("sent_no").alias("sent_no"))
    k = F.row_number().over(W.partitionBy("key", "pattern", "seq").orderBy("sent_no", "example"))
    seen = seen.withColumn("example_no", k).where(F.col("example_no") <= limit)
    return seen.select("key", "pattern", F.format_string("WORD_%02d", F.col("seq")).alias("placeholder"), "example_no", "example")
