"""Structured sources: STIX bundles, vulnerability catalogues, JSON-lines backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

STIX = (
    "type string, id string, name string, description string, aliases array<string>, x_mitre_aliases array<string>, "
    "external_references array<struct<source_name:string,external_id:string,url:string>>, "
    "kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>, relationship_type string, "
    "source_ref string, target_ref string, revoked boolean, x_mitre_deprecated boolean, x_mitre_is_subtechnique boolean, "
    "x_mitre_platforms array<string>, first_seen string, last_seen string"
)
KEV = (
    "cveID string, vendorProject string, product string, vulnerabilityName string, dateAdded string, dueDate string, "
    "shortDescription string, requiredAction string, knownRansomwareCampaignUse string"
)


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """Active objects of a bundle; revoked and deprecated ones are left out."""
    bundle = spark.read.schema(StructType().add("objects", ArrayType(StructType.fromDDL(STIX)))).json(path, multiLine=True)
    o = bundle.select(F.explode("objects").alias("o")).select("o.*")
    return o.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)))


def external_id(o: Column) -> Column:
    return F.filter(o, lambda r: r["source_name"].startswith("mitre"))[0]["external_id"]


def stix_techniques(objects: DataFrame) -> DataFrame:
    """(ref, id, name, tactics, platforms, parent): a child's name stands behind its parent's."""
    t = objects.where("type = 'attack-pattern'").select(
        F.col("id").alias("ref"), external_id(F.col("external_references")).alias("id"), "name", F.transform("kill_chain_phases", lambda p: p["phase_name"]).alias("tactics"), F.col("x_mitre_platforms").alias("platforms")
    )
    t = t.where("id is not null").withColumn("parent", F.when(F.col("id").contains("."), F.split("id", r"\.")[0]))
    up = t.select(F.col("id").alias("parent"), F.col("name").alias("_up"))
    return t.join(up, "parent", "left").select("ref", "id", F.concat_ws(": ", "_up", "name").alias("name"), "tactics", "platforms", "parent")


def stix_actors(objects: DataFrame) -> DataFrame:
    """(id, name, aliases, techniques, software) of every group; a group has what it
    uses itself and the software of campaigns attributed to it."""
    rel = objects.where("type = 'relationship'").select("relationship_type", "source_ref", "target_ref")
    uses, part = rel.where("relationship_type = 'uses'"), rel.where("relationship_type = 'attributed-to'")
    own = uses.select(F.col("source_ref").alias("ref"), "target_ref", F.lit(True).alias("direct"))
    by_campaign = part.select("source_ref", F.col("target_ref").alias("ref")).join(uses.select("source_ref", "target_ref"), "source_ref").select("ref", "target_ref", F.lit(False).alias("direct"))
    kinds = objects.where("type in ('attack-pattern', 'malware', 'tool')").select(F.col("id").alias("target_ref"), "type", external_id(F.col("external_references")).alias("xid"))
    facts = own.union(by_campaign).join(kinds, "target_ref").where((F.col("type") != "attack-pattern") | F.col("direct"))
    sets = facts.groupBy("ref").agg(
        F.array_sort(F.collect_set(F.when(F.col("type") == "attack-pattern", F.col("xid")))).alias("techniques"), F.array_sort(F.collect_set(F.when(F.col("type") != "attack-pattern", F.col("xid")))).alias("software")
    )
    groups = objects.where("type = 'intrusion-set'").select(F.col("id").alias("ref"), external_id(F.col("external_references")).alias("id"), "name", F.coalesce("aliases", "x_mitre_aliases").alias("aliases"))
    none = F.array().cast("array<string>")
    return groups.join(sets, "ref", "left").select("id", "name", F.array_except(F.coalesce("aliases", none), F.array("name")).alias("aliases"), F.coalesce("techniques", none).alias("techniques"), F.coalesce("software", none).alias("software"))


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    """Known exploited vulnerabilities: ids upper case, bad ids left out, the first of repeated ones."""
    raw = spark.read.schema(StructType().add("vulnerabilities", ArrayType(StructType.fromDDL(KEV)))).json(path, multiLine=True)
    v = raw.select(F.posexplode("vulnerabilities").alias("n", "v")).select("n", "v.*").withColumn("cveID", F.upper(F.trim("cveID")))
    v = v.where(F.col("cveID").rlike(r"^CVE-\d{4}-\d{4,}$"))
    rest = [c for c in v.columns if c not in ("n", "cveID")]
    first = v.groupBy("cveID").agg(F.min_by(F.struct(*rest), "n").alias("r")).select("cveID", "r.*")
    return first.withColumn("ransomware", F.lower("knownRansomwareCampaignUse") == "known")


def kev_matches(vulnerabilities: DataFrame, kev: DataFrame, cve: str = "cve") -> DataFrame:
    """Vulnerabilities with what the catalogue says of them: ransomware first, then listed, then the rest."""
    side = kev.select(F.col("cveID").alias("_id"), "dateAdded", "dueDate", "requiredAction", "ransomware")
    j = vulnerabilities.join(side, F.upper(cve) == F.col("_id"), "left").withColumn("listed", F.col("_id").isNotNull()).drop("_id")
    return j.orderBy(F.desc(F.coalesce("ransomware", F.lit(False))), F.desc("listed"), cve)


def options_by_technique(options: DataFrame, wanted: DataFrame, technique: str = "technique_id", most: int = 120) -> DataFrame:
    """Options of the wanted techniques and of their children, most of each at most (a shown list), by kind and name."""
    from siftwork.operators.relational import by_prefix, top_per_group

    hit = by_prefix(options, technique, wanted.select(F.col(technique).alias("wanted")).distinct(), "wanted")
    return top_per_group(hit, ["wanted"], [F.col("kind"), F.col("name")], most)


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a JSON-lines backup: (collection, id, doc_type, doc, sha); the
    extended forms of ids and dates are read as plain strings."""
    raw = spark.read.text(path).withColumn("path", F.input_file_name())
    oid = F.coalesce(F.get_json_object("value", "$._id.$oid"), F.get_json_object("value", "$._id"))
    return raw.select(
        F.regexp_extract("path", r"([^/]+?)(?:\.jsonl?)?(?:\.gz)?$", 1).alias("collection"), oid.alias("id"), F.get_json_object("value", "$.docType").alias("doc_type"), F.translate("value", chr(0), "").alias("doc"), F.sha2(F.translate("value", chr(0), ""), 256).alias("sha")
    )


def route(docs: DataFrame, routes: dict[str, str], doc_type: str = "doc_type", other: str = "unclassified_documents") -> DataFrame:
    """Adds the table each document goes to; unknown types go to one of their own."""
    known = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    return docs.withColumn("route", F.coalesce(F.try_element_at(known, F.col(doc_type)), F.lit(other)))


def stix_report(reports: DataFrame) -> DataFrame:
    """(report_id, stix): a report as a STIX object; confidence is quality in percent, halves up."""
    body = F.struct(
        F.lit("report").alias("type"), F.lit("2.1").alias("spec_version"), F.concat(F.lit("report--"), "report_id").alias("id"), F.col("title").alias("name"), F.col("published").alias("published"),
        F.floor(F.col("quality") * 100 + 0.5).cast("int").alias("confidence"), F.col("labels").alias("labels"), F.col("refs").alias("object_refs"),
    )
    return reports.select("report_id", F.to_json(body).alias("stix"))
