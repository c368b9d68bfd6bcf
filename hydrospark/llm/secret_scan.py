"""Secret scans over an incremental ledger of text versions, in DataFrame functions only.

A version of a text is known by its content address (SHA-256). The ledger holds, for every version
of the rules, the addresses already scanned and what was found in them; a scan reads texts only for
pairs of address and rule version that it lacks, each text once however many documents carry it, and
then joins the findings back to all documents.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrospark.functions.base import once
from hydrospark.llm.shared import spare

#: Marks put around matches, and what stands for them where a text itself holds them.
_OPEN, _CLOSE, _OTHER = "\ue000", "\ue001", "\ufffd"

FINDING = "array<struct<start:int,place:int,end:int,kind:string,base:boolean>>"
#: Pieces of a text (matches and what lies between them) that are walked over at a time, an even number. A walk copies what
#: it has gathered at every step, so that short walks keep the work in proportion to the matches.
WALK = 64

#: What follows the first line of a private key: all up to the next run of five dashes if that is its END line, or
#: else header fields and the base64 block, with a shorter last line. No part of it can hold another first line.
_KEY_BODY = (r"(?:(?>[\s\S]*?-----)-*+END [A-Z ]*PRIVATE KEY-----"
             r"|(?:[\s\\>\"']*+(?:Proc-Type|DEK-Info):[^\n]*+)*+(?:[\s\\>\"']*+[A-Za-z0-9+/]{16,}+={0,2}+)++"
             r"(?:[\s\\>\"']++(?:[A-Za-z0-9+/]*+=++|[A-Za-z0-9+/]++(?=[\"']?[^\S\n]*+(?:\n|\\|\z))))?+)?+")


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are leftmost and do not overlap; `group` must have `least` characters.

    A text is searched only if it holds one of `needles`, where there are any. `body` is what belongs to a secret
    behind its match and to its span.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    needles: tuple[str, ...] = ()
    body: str = ""


RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         group=2, least=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True, needles=("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needles=("PRIVATE KEY-----",), body=_KEY_BODY),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needles=("eyJ",)),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s/@]+@", needles=("://",)),
    Rule("prefixed", r"(?:gh[pousr]_|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,}",
         needles=("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_")),
)


def rules_version(rules: tuple[Rule, ...]) -> str:
    """A digest of the rules: any change of them makes every version unseen."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """Matches of one rule, by code points: text between marks alternates with matches."""
    marked = F.regexp_replace(text, rule.pattern + rule.body, f"{_OPEN}$0{_CLOSE}")
    pieces = F.split(marked, f"[{_OPEN}{_CLOSE}]", -1)
    empty = F.array().cast(FINDING)
    long_enough = (lambda m: F.length(m) >= rule.least) if rule.group == 0 else (
        lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least)

    def step(done: Column, piece: Column) -> Column:
        end = done["at"] + F.length(piece)
        span = F.array(F.struct(done["at"].alias("start"), F.lit(place).alias("place"), end.alias("end"),
                                F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base")))
        return F.struct(end.alias("at"), (~done["match"]).alias("match"),
                        F.when(done["match"] & long_enough(piece), F.concat(done["out"], span))
                        .otherwise(done["out"]).alias("out"))

    def length(walk: Column) -> Column:
        return F.aggregate(walk, F.lit(0), lambda total, piece: total + F.length(piece))

    def starts(walks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(walks, first, lambda done, walk: F.struct(
            (done["at"] + length(walk)).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")), lambda done: done["out"])

    def walked(walk: Column, at: Column) -> Column:
        return F.aggregate(walk, F.struct(at.alias("at"), F.lit(False).alias("match"), empty.alias("out")), step, lambda done: done["out"])

    def gathered(split: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.floor((F.size(split) - 1) / WALK).cast("int")), lambda i: F.slice(split, i * WALK + 1, WALK))
        whole = once(many, lambda walks: F.flatten(F.zip_with(walks, starts(walks), walked)))
        return F.when(F.size(split) <= WALK, walked(split, F.lit(0))).otherwise(whole)

    found = once(pieces, gathered).cast(FINDING)
    wanted = None
    for needle in rule.needles:
        wanted = text.contains(needle) if wanted is None else wanted | text.contains(needle)
    return found if wanted is None else F.when(wanted, found).otherwise(empty)


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text by start, then by the order of the rules."""
    plain = F.translate(text, _OPEN + _CLOSE, _OTHER * 2)
    return F.sort_array(F.concat(*[_spans(plain, rule, i) for i, rule in enumerate(rules)]))


class Ledger:
    """Scanned versions and their findings, a folder of Parquet files by rule version.

    Every scan adds files and rewrites none. A scan that fails leaves no committed file, so that its
    versions count as unseen; one that is repeated finds nothing left to do.
    """

    SCHEMA = f"blob string, found {FINDING}, rules string"

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules, self.version = spark, path, rules, rules_version(rules)

    def entries(self) -> DataFrame:
        """Everything scanned under this version of the rules."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return self.spark.createDataFrame([], self.SCHEMA).drop("rules")
        return (self.spark.read.schema(self.SCHEMA).parquet(self.path)
                .where(F.col("rules") == self.version).drop("rules"))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, blob, found) of every row, after the unseen versions among them have been scanned.

        Null texts count as empty. Rows with one text share one version; null ids and repeated rows
        stay rows. Further columns are not read.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        versions = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("blob"),
                               text.alias("text"))
        # Copies are dropped within tasks before the shuffle, so that a text many documents carry is no hot key.
        unseen = (versions.select("blob", "text").dropDuplicates(["blob"])
                  .join(self.entries().select("blob"), "blob", "left_anti"))
        (unseen.select("blob", findings(F.col("text"), self.rules).alias("found"), F.lit(self.version).alias("rules"))
         .write.mode("append").partitionBy("rules").parquet(self.path))
        known = self.entries().withColumnRenamed("blob", "known")
        return (versions.select("doc_id", "blob").join(known, F.col("blob") == F.col("known"), "left")
                .select("doc_id", "blob", F.coalesce("found", F.array().cast(FINDING)).alias("found")))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def without_secrets(docs: DataFrame, ledger: Ledger, mask: str = "x", id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """The documents with every character of a found span replaced by `mask`, all columns kept.

    Lengths stay. Spans may overlap; a null text stays null.
    """
    blob_of, spans_of = spare(docs, "blob_of"), spare(docs, "spans_of")
    found = (ledger.scan(docs, id_col, text_col).select("blob", "found").where(F.size("found") > 0)
             .dropDuplicates(["blob"]).withColumnsRenamed({"blob": blob_of, "found": spans_of}))
    text = docs[text_col]
    blob = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)

    def step(done: Column, s: Column) -> Column:
        begin = F.greatest(done["at"], s["start"])
        return F.when(s["end"] <= done["at"], done).otherwise(F.struct(
            F.concat(done["out"], F.substring(text, done["at"] + 1, begin - done["at"]),
                     F.repeat(F.lit(mask), s["end"] - begin)).alias("out"), s["end"].alias("at")))

    masked = F.aggregate(spans_of, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
                         lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    out = docs.join(found, blob == F.col(blob_of), "left")
    new = F.when(F.col(spans_of).isNotNull(), masked).otherwise(text)
    return out.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
