"""Input, output and access rules over tables of requests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import redact, sanitize

#: Patterns that a request, an answer, may not match.
INPUT_PATTERNS = (
    r"(?i)ignore (all|previous|above) (instructions|rules)",
    r"(?i)reveal (system|hidden) prompt",
    r"(?i)break the rules",
    r"(?i)你現在不需要遵守|忽略前面的規則",
    r"(?i)http://127\.0\.0\.1",
    r"(?i)http://169\.254\.",
    r"(?i)file://",
    r"(?i)DROP\s+TABLE",
    r"(?i)DELETE\s+FROM",
    r"(?i)UPDATE\s+\w+\s+SET",
    r"\.\./",
)
OUTPUT_PATTERNS = (r"(?i)TOP-SECRET", r"(?i)internal-only", r"請忽略之前", r"reveal system prompt")
MODES = ("off", "report", "enforce")


@dataclass(frozen=True)
class Policy:
    input_patterns: tuple[str, ...] = INPUT_PATTERNS
    output_patterns: tuple[str, ...] = OUTPUT_PATTERNS
    redact: tuple[str, ...] = ("email", "phone")
    doc_roles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"doc_handbook": ("employee", "admin"), "doc_finance": ("admin",)})
    mode: str = "enforce"
    max_input_length: int = 1_000_000


def _violations(text: Column, patterns: tuple[str, ...], stage: str, mode: str) -> Column:
    """The patterns that match, in order; in enforce mode the first alone.  Literal patterns compile once a task."""
    if mode == "off" or not patterns:
        return F.array().cast("array<string>")
    named = [F.when(text.rlike(p), F.lit(f"{stage}:{p}")) for p in patterns]
    if mode == "enforce":
        first = F.coalesce(*named)
        return F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.array(first))
    return F.array_compact(F.array(*named))


def check_input(text: Column, policy: Policy, mode: str | None = None) -> Column:
    """struct(blocked, violations) of a request; only enforce blocks; text past the limit isn't looked at."""
    mode = mode or policy.mode
    found = _violations(F.left(F.coalesce(text, F.lit("")), F.lit(policy.max_input_length)), policy.input_patterns, "input", mode)
    return F.struct(((F.size(found) > 0) & (mode == "enforce")).alias("blocked"), found.alias("violations"))


def check_output(text: Column, policy: Policy, mode: str | None = None) -> Column:
    """struct(blocked, violations) of an answer, whatever its length."""
    mode = mode or policy.mode
    found = _violations(F.coalesce(text, F.lit("")), policy.output_patterns, "output", mode)
    return F.struct(((F.size(found) > 0) & (mode == "enforce")).alias("blocked"), found.alias("violations"))


def enforce_acl(role: Column, doc_ids: Column, policy: Policy, mode: str | None = None) -> Column:
    """struct(allowed, violations): documents that the role may not see; one without roles is open to none."""
    mode = mode or policy.mode
    none = F.array().cast("array<string>")
    if mode == "off":
        return F.struct(F.lit(True).alias("allowed"), none.alias("violations"))

    def may(doc: Column) -> Column:
        out = F.lit(False)
        for name, roles in policy.doc_roles.items():
            out = F.when(doc == name, F.coalesce(role.isin(*roles), F.lit(False))).otherwise(out)
        return out

    denied = F.transform(F.filter(doc_ids, lambda d: ~may(d)), lambda d: F.concat(F.lit("acl_denied:"), d))
    if mode == "enforce":
        denied = F.slice(denied, 1, 1)
    return F.struct(((F.size(denied) == 0) | (mode != "enforce")).alias("allowed"), denied.alias("violations"))


def acl_violations(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows (req_id, role, doc_id) that no grant(doc_id, role) covers, where grants are a table."""
    return requests.join(grants, ["doc_id", "role"], "left_anti")


def route_document(query: Column, rules: dict[str, tuple[str, ...]], default: str) -> Column:
    """The first document one of whose keywords is in the query."""
    low, out = F.lower(F.coalesce(query, F.lit(""))), F.lit(default)
    for doc, words in reversed(rules.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, doc).otherwise(out)
    return out


#: Words that lead to the finance document.
FINANCE = {"doc_finance": ("finance", "財務", "報銷", "預算", "會計")}


def guarded(requests: DataFrame, answer: Column, policy: Policy, mode: str | None = None, rules: dict = FINANCE, default: str = "doc_handbook") -> DataFrame:
    """requests(text, role) through every gate: status (ok or blocked), reason (input, acl, output), routed_to,
    answer and n_redacted.

    Sanitise, check the request, route it to a document, check access, answer, redact, check the answer.
    The first gate that blocks gives the reason; what it blocks has no answer.
    """
    mode = mode or policy.mode
    rows = requests.withColumn("clean", sanitize("text")).withColumn("_in", check_input(F.col("clean"), policy, mode))
    rows = rows.withColumn("routed_to", route_document(F.col("clean"), rules, default)).withColumn("_acl", enforce_acl(F.col("role"), F.array("routed_to"), policy, mode))
    # what a gate before has blocked has no answer to redact, and the patterns are costly
    rows = rows.withColumn("_red", F.when(~F.col("_in.blocked") & F.col("_acl.allowed"), redact(answer, mode, policy.redact,
        policy.max_input_length))).withColumn("_out", check_output(F.col("_red.text"), policy, mode))
    reason = F.when(F.col("_in.blocked"), "input").when(~F.col("_acl.allowed"), "acl").when(F.col("_out.blocked"), "output")
    counts = F.aggregate(F.map_values("_red.stats"), F.lit(0), lambda a, b: a + b) + F.col("_red.truncated").cast("int")
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "ok").otherwise("blocked"))
    rows = rows.withColumn("answer", F.when(reason.isNull(), F.col("_red.text"))).withColumn("n_redacted",
        F.when(F.col("reason").isNull() | (F.col("reason") == "output"), counts).otherwise(0))
    return rows.withColumn("violations", F.concat("_in.violations", "_acl.violations", "_out.violations")).drop("_in", "_acl", "_red", "_out")


def policy_of(rules: DataFrame) -> Policy:
    """The policy in a table rules(stage, ord, pattern): stages input and output, patterns in order of ord.

    Called for each micro-batch (``checked_by``), so that a changed table takes effect with the next one.
    """
    found = sorted((r.stage, r.ord, r.pattern) for r in rules.select("stage", "ord", "pattern").collect())
    return Policy(*[tuple(p for stage, _, p in found if stage == wanted) for wanted in ("input", "output")])


def checked_by(rules, sink, mode: str = "enforce"):
    """For foreachBatch: requests of a batch checked by the policy as it is now; ``rules()`` reads it, ``sink(df, batch)`` takes the rows."""

    def check(batch: DataFrame, number: int) -> None:
        sink(batch.withColumn("gate", check_input(F.col("text"), policy_of(rules()), mode)), number)

    return check
