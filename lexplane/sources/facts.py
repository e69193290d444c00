"""Curated facts (CSV) as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import triples as G

#: The columns of the CSV, and the articles of each jurisdiction's duration and rights.
COLUMNS = "id name law_label source_url duration_literary duration_literary_special duration_software duration_software_special reproduction distribution communication rental translation rights_note reproduction_article distribution_article communication_article rental_article translation_article in_force_since last_amended private_copy_exception".split()
RIGHTS = "reproduction distribution communication rental translation".split()
DURATION_ARTICLES = {"DE": "§ 64 UrhG", "UK": "s. 12 CDPA", "US": "§ 302 17 U.S.C.", "FR": "L123-1 CPI", "IT": "Art. 25 LDA", "CH": "Art. 29 URG", "EU": "Art. 1 Directive 2006/116", "CA": "s. 6 Copyright Act", "NZ": "s. 22 Copyright Act 1994"}
RIGHTS_ARTICLES = {"DE": "§ 15 UrhG", "UK": "s. 16 CDPA", "US": "§ 106 17 U.S.C.", "FR": "L122-1 CPI", "IT": "Art. 12 LDA", "CH": "Art. 10 URG", "EU": "Art. 2 InfoSoc Directive", "CA": "s. 3 Copyright Act", "NZ": "s. 16 Copyright Act 1994"}
BASELINE_YEARS = 50


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, escape='"', schema=", ".join(f"{c} string" for c in COLUMNS)).withColumn("id", F.trim("id"))


def _named(c, names: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c)


def triples(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """The graph of facts; documents (code, rule, path, title) names each rule's document, a null rule is for all.

    A duration, a rights and an exception node a jurisdiction, a node for each right with an article, and the treaty
    baseline with a compliesWith edge from each duration that reaches it.
    """
    code = F.col("id")
    rules = {"duration": "copyright duration", "rights": "economic rights", "exception": "personal-use exception"}
    own = documents.where("rule is not null").select(F.col("code").alias("id"), "rule", F.struct("path", "title").alias("doc"))
    general = documents.where("rule is null").select(F.col("code").alias("id"), F.struct("path", "title").alias("doc"))
    parts = []
    for kind, rule in rules.items():
        df = facts.join(own.where(F.col("rule") == rule).select("id", F.col("doc").alias("__a")), "id", "left").join(general.select("id", F.col("doc").alias("__b")), "id", "left")
        doc = F.coalesce("__a", "__b")
        common = {
            "rdf:type": G.uri(F.lit("ipronto:ExceptionsRight" if kind == "exception" else "ipronto:ExploitationRight")),
            "legal:jurisdiction": G.literal(code),
            "legal:jurisdictionName": G.literal(F.col("name")),
            "legal:ruleType": G.literal(F.lit(rule)),
            "legal:localPath": G.literal(F.coalesce(doc["path"], F.lit(""))),
            "legal:docTitle": G.literal(F.coalesce(doc["title"], F.lit(""))),
            "legal:sourceUrl": G.literal(F.nullif(F.trim("source_url"), F.lit(""))),
            "legal:isAuthoritative": G.literal(F.lit("false"), "boolean"),
        }
        years = T.duration_years(F.col("duration_literary"))
        special = {
            "duration": {
                "legal:durationLiterary": G.literal(F.col("duration_literary")),
                "legal:durationSoftware": G.literal(F.col("duration_software")),
                "legal:articleRef": G.literal(_named(code, DURATION_ARTICLES)),
                "legal:durationYears": G.literal(years, "integer"),
                "ipronto:triggeredBy": G.literal(F.when(T.by_death(F.col("duration_literary")), "death of author")),
                "legal:compliesWith": G.uri(F.when(years >= BASELINE_YEARS, "ex:WIPO_berne_art7")),
            },
            "rights": {"legal:rightsNote": G.literal(F.coalesce("rights_note", F.lit(""))), "legal:articleRef": G.literal(_named(code, RIGHTS_ARTICLES))},
            "exception": {
                "legal:exceptionText": G.literal(F.coalesce(F.trim("private_copy_exception"), F.lit(""))),
                "legal:hasException": G.literal(F.coalesce(T.says_yes(F.trim("private_copy_exception")), F.lit(False)), "boolean"),
                "legal:articleRef": G.literal(F.nullif(T.exception_article(F.col("private_copy_exception")), F.lit(""))),
            },
        }[kind]
        parts.append(G.expand(df, F.concat(F.lit("ex:"), code, F.lit(f"_{kind}")), {**common, **special}))
    each = facts.select("id", F.explode(F.array(*[F.struct(F.lit(r).alias("right"), F.col(r).alias("granted"), F.trim(f"{r}_article").alias("article")) for r in RIGHTS])).alias("r")).select("id", "r.*").where(T.is_true(F.col("granted")))
    node, owner = F.concat(F.lit("ex:"), code, F.lit("_right_"), F.col("right")), F.concat(F.lit("ex:"), code, F.lit("_rights"))
    cited = T.has_article(F.col("article"))
    parts.append(G.expand(each, owner, {"legal:hasRight": G.literal(F.col("right")), "legal:hasRightDetail": G.uri(F.when(cited, node))}))
    parts.append(G.expand(each.where(cited), node, {"legal:rightName": G.literal(F.col("right")), "legal:articleRef": G.literal(F.col("article"))}))
    baseline = {
        "rdf:type": G.uri(F.lit("ipronto:ExploitationRight")), "legal:jurisdiction": G.literal(F.lit("WIPO")), "legal:jurisdictionName": G.literal(F.lit("WIPO (Berne Convention)")),
        "legal:ruleType": G.literal(F.lit("copyright duration")), "legal:durationLiterary": G.literal(F.lit("50 years pma (minimum)")), "legal:durationYears": G.literal(F.lit(BASELINE_YEARS), "integer"),
        "legal:articleRef": G.literal(F.lit("Art. 7 Berne Convention")), "legal:docTitle": G.literal(F.lit("Berne Convention for the Protection of Literary and Artistic Works")), "ipronto:triggeredBy": G.literal(F.lit("death of author")),
    }
    parts.append(G.expand(facts.sparkSession.range(1), F.lit("ex:WIPO_berne_art7"), baseline))
    return G.as_set(G.union(parts))


def with_metadata(graph: DataFrame, frbr: DataFrame) -> DataFrame:
    """graph with what the documents at legal:localPath say of themselves; frbr: akn.frbr() of them, doc being the path.

    A document's own locator replaces the source of the facts, and its word on being authentic the default. Rules
    without a document keep their triples.
    """
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    rules = graph.where("p = 'legal:localPath' and o <> ''").select("s", F.col("o").alias("doc")).join(frbr, "doc")
    fields = {
        "legal:sourceUrl": G.literal(said("source_uri")), "legal:frbrWorkUri": G.literal(said("work_uri")), "legal:frbrThis": G.literal(said("this")), "legal:eliUri": G.literal(said("eli")),
        "legal:pointInTime": G.literal(said("point_in_time"), "date"), "legal:dateInForce": G.literal(said("in_force"), "date"), "legal:isAuthoritative": G.literal(F.col("authoritative"), "boolean"),
    }
    own = G.expand(rules, F.col("s"), fields)
    replaced = own.where("p in ('legal:sourceUrl', 'legal:isAuthoritative')").select("s", "p")
    return G.as_set(graph.join(replaced, ["s", "p"], "left_anti").select(*G.COLUMNS).unionByName(own))
