"""Rules over the graph: compliance verdicts, evidence, answers, cards and the drawable graph, for all rules at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import triples as G

RULE_KEYS = {"copyright duration": "duration", "economic rights": "rights", "personal-use exception": "exception"}
COUNTRIES = [("DE", "Germany"), ("FR", "France"), ("IT", "Italy"), ("CH", "Switzerland"), ("UK", "United Kingdom"), ("US", "United States"), ("CA", "Canada"), ("NZ", "New Zealand"), ("EU", "European Union")]
CARDS = {"copyright duration": "rule_card", "economic rights": "rights_list", "personal-use exception": "yes_no_exception"}


def verdict(rules: DataFrame, years: str, baseline: Column) -> DataFrame:
    """rules with baseline, compliant and margin; a rule without years has null ones. The baseline is one value, so there is no join."""
    return rules.withColumn("baseline", baseline.cast("bigint")).withColumn("compliant", F.col(years) >= F.col("baseline")).withColumn("margin", F.col(years) - F.col("baseline"))


def compliance(triples: DataFrame, baseline_node: str = "ex:WIPO_berne_art7") -> DataFrame:
    """A verdict for each jurisdiction of the graph against the baseline node's years; null verdicts if the graph has no such node."""
    arms = {"country_name": "legal:jurisdictionName", "code": "legal:jurisdiction", "years": "legal:durationYears", "text": "legal:durationLiterary"}
    found = G.star(triples, arms, {"article": "legal:articleRef", "path": "legal:localPath", "title": "legal:docTitle", "source_url": "legal:sourceUrl"})
    here = F.col("s") == baseline_node
    of = lambda c: F.min(F.when(here, c))
    base = found.agg(of(F.col("years").cast("bigint")).alias("base"), of(F.col("country_name")).alias("treaty_name"), of(F.col("article")).alias("treaty_article"))  # always one row
    rules = found.where(~here).withColumn("years", F.col("years").cast("bigint")).crossJoin(F.broadcast(base))
    return verdict(rules, "years", F.col("base")).drop("base")


def answer(name: Column, rule: Column, duration: Column, rights: Column, has: Column, exception: Column) -> Column:
    """The one-sentence answer of each rule type."""
    yes = F.concat(F.when(has, "Yes, ").otherwise("No, "), name, F.when(has, " has").otherwise(" does not have"), F.lit(" a private-copy exception. "), exception)
    return (
        F.when(rule == "copyright duration", F.concat(F.lit("Copyright protection in "), name, F.lit(" lasts "), duration, F.lit(".")))
        .when(rule == "economic rights", F.concat(name, F.lit(" grants: "), rights, F.lit(".")))
        .when(rule == "personal-use exception", yes)
        .otherwise("")
    )


def full_answer(short: Column, passage: Column, article: Column, title: Column, path: Column, country: Column, span: Column | None = None) -> Column:
    """Answer, evidence, reference and document in sections; a fixed sentence without a passage, a note without a country. span: what supports the answer, underlined."""
    note = F.when(F.coalesce(country, F.lit("")) == "", "\n\nNote: no country was named; the treaty baseline was used.").otherwise("")
    body = F.concat(F.lit("Answer: "), short, F.lit("\n\nEvidence: "), T.underline(passage, F.lit("") if span is None else span), F.lit("\n\nReference: "), T.format_reference(article, F.lit("")), F.lit("\n\nDocument: "), T.document_link(title, path), note)
    return F.when(F.coalesce(F.trim(passage), F.lit("")) == "", "No passage was found that supports an answer.").otherwise(body)


def card(rule: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, kind in CARDS.items():
        out = out.when(rule == name, kind)
    return out.otherwise("rule_card")


#: How normal values are shown.
SHOWN = {"life_plus_70": "Life of author + 70 years", "life_plus_50": "Life of author + 50 years", "list": "Multiple rights recognized", "yes": "Yes — exception provided", "no": "No — exception not provided", "unknown": "Unknown"}


def display_value(value: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SHOWN.items() for x in kv]), value), value)


def route(questions: DataFrame) -> DataFrame:
    """questions (question, country, topic) with code, rule and rule_key: general topics ask for rights, unknown countries for the treaty."""
    codes = F.create_map(*[F.lit(x) for c, n in COUNTRIES for x in (n.lower(), c)])
    topic = F.when(F.col("topic").isin("copyright", "intellectual property"), "economic rights").otherwise(F.col("topic"))
    keys = F.create_map(*[F.lit(x) for kv in RULE_KEYS.items() for x in kv])
    out = questions.withColumn("code", F.coalesce(F.element_at(codes, F.lower(F.trim("country"))), F.lit("WIPO"))).withColumn("rule", topic)
    return out.withColumn("rule_key", F.coalesce(F.element_at(keys, F.col("rule")), F.lit("")))


def enrich(questions: DataFrame) -> DataFrame:
    """questions (question) with country and topic found by keyword: the stand-in for a language model, and replaceable by one."""
    q = F.lower("question")
    country = F.coalesce(*[F.when(q.contains(n.lower()), n) for _, n in COUNTRIES])
    topic = F.when(q.rlike("how long|duration|last|term|expire"), "copyright duration").when(q.rlike("private|personal|exception"), "personal-use exception").when(q.rlike("right|reproduc|distribut|rental"), "economic rights").otherwise("intellectual property")
    return questions.withColumn("country", country).withColumn("topic", topic)


def evidence(params: DataFrame, triples: DataFrame) -> DataFrame:
    """params (code, rule) with evidence: answer, value, article, path, title, source_url; blank where the graph has none.

    All questions are answered in one plan: three stars, one list of rights a node, and one join.
    """
    rule = {"rule": "legal:ruleType", "code": "legal:jurisdiction", "name": "legal:jurisdictionName"}
    more = {"duration": "legal:durationLiterary", "exception": "legal:exceptionText", "has": "legal:hasException", "article": "legal:articleRef", "path": "legal:localPath", "title": "legal:docTitle", "source_url": "legal:sourceUrl"}
    nodes = G.star(triples, rule, more).join(rights_list(triples), "s", "left")
    has = F.col("has") == "true"
    value = F.when(F.col("rule") == "copyright duration", T.duration_kind(F.lower("duration"))).when(F.col("rule") == "economic rights", "list").when(has, "yes").otherwise("no")
    nodes = nodes.withColumn("answer", answer(F.col("name"), F.col("rule"), F.col("duration"), F.coalesce("rights", F.lit("")), has, F.col("exception"))).withColumn("value", value)
    kept = ["answer", "value", "article", "path", "title", "source_url"]
    out = params.join(nodes.select("code", "rule", *kept), ["code", "rule"], "left")
    return out.select(*params.columns, *[F.coalesce(c, F.lit("")).alias(c) for c in kept])


def bindings(params: DataFrame, triples: DataFrame) -> DataFrame:
    """params (code, rule) with node, name, text and article: a row for each rule node that a question's pattern binds.

    The pattern is that of the rule's kind, that of durations for any other; a blank code binds the nodes of all
    jurisdictions. Unlike evidence(), nothing is made up for what binds nothing.
    """
    arms = {"kind": "legal:ruleType", "of": "legal:jurisdiction", "name": "legal:jurisdictionName"}
    nodes = G.star(triples, arms, {"duration": "legal:durationLiterary", "exception": "legal:exceptionText", "article": "legal:articleRef"}).join(rights_list(triples), "s", "left")
    shown = F.when(F.col("kind") == "copyright duration", F.col("duration")).when(F.col("kind") == "economic rights", F.col("rights")).otherwise(F.col("exception"))
    nodes = nodes.select(F.col("s").alias("node"), "kind", "of", "name", shown.alias("text"), "article").where("text is not null")
    asked = params.withColumn("kind", F.when(F.col("rule").isin(*RULE_KEYS), F.col("rule")).otherwise("copyright duration"))
    blank = F.coalesce(F.trim("code"), F.lit("")) == ""
    one = asked.where(~blank).withColumn("of", F.upper(F.trim("code"))).join(nodes, ["kind", "of"])
    every = asked.where(blank).join(nodes, "kind")
    kept = [*params.columns, "node", "name", "text", "article"]
    return one.select(*kept).unionByName(every.select(*kept))


def rights_list(triples: DataFrame) -> DataFrame:
    """(s, rights): the distinct rights of a node, sorted, in one text."""
    return G.objects(triples, "legal:hasRight", "right").groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("right")), ", ").alias("rights"))


def fallback(params: DataFrame, records: DataFrame) -> DataFrame:
    """params (code, rule) with the record that stands in for the graph: the code's own of that rule, else the rule's first, else blanks.

    records (n, code, rule, answer, article) is a small constant relation; n is its order.
    """
    value = F.struct("answer", "article")
    own = records.groupBy("code", "rule").agg(F.min_by(value, "n").alias("own"))
    first = records.groupBy("rule").agg(F.min_by(value, "n").alias("first"))
    out = params.join(F.broadcast(own), ["code", "rule"], "left").join(F.broadcast(first), "rule", "left")
    found = F.coalesce("own", "first")
    return out.select(*params.columns, F.coalesce(found["answer"], F.lit("")).alias("answer"), F.coalesce(found["article"], F.lit("")).alias("article"))


def law_ids(nodes: DataFrame) -> DataFrame:
    """(code, title, law): the laws of each jurisdiction's rule nodes (s, code, rule, title) as law_1, law_2, ... in the order of first use.

    Rules come in the order of RULE_KEYS; within one, nodes by their name.
    """
    place = F.element_at(F.create_map(*[F.lit(x) for n, r in enumerate(RULE_KEYS) for x in (r, n)]), F.col("rule"))
    used = nodes.where("title <> ''").groupBy("code", "title").agg(F.min(F.struct(place.alias("place"), "s")).alias("first"))
    n = F.row_number().over(Window.partitionBy("code").orderBy("first", "title"))
    return used.select("code", "title", F.concat(F.lit("law_"), n.cast("string")).alias("law"))


def query_text(code: Column) -> Column:
    """The text of the graph query of a jurisdiction, for display."""
    return F.concat(F.lit('SELECT ?s ?p ?o WHERE { ?s legal:jurisdiction "'), F.upper(F.trim(code)), F.lit('" . ?s ?p ?o } ORDER BY ?s ?p'))


def vertices(nodes: DataFrame) -> DataFrame:
    """(id, label, type) of rule nodes (s, code, name, rule, title) and of the jurisdictions and laws they belong to."""
    country = nodes.select(F.concat(F.lit("country_"), "code").alias("id"), F.col("name").alias("label"), F.lit("country").alias("type"))
    rule = nodes.select(F.col("s").alias("id"), F.col("rule").alias("label"), F.lit("rule").alias("type"))
    law = nodes.where("title <> ''").select(F.concat(F.lit("law_"), "title").alias("id"), F.col("title").alias("label"), F.lit("law").alias("type"))
    return country.union(rule).union(law).distinct()


def edges(nodes: DataFrame) -> DataFrame:
    """(source, target, label): jurisdiction to rule, rule to law."""
    has = nodes.select(F.concat(F.lit("country_"), "code").alias("source"), F.col("s").alias("target"), F.lit("has rule").alias("label"))
    law = nodes.where("title <> ''").select(F.col("s").alias("source"), F.concat(F.lit("law_"), "title").alias("target"), F.lit("stated in").alias("label"))
    return has.union(law).distinct()
