"""Task and label catalogs as small fixed tables (8 tasks, 247 labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names per example type, tasks with their type, label names per task.
EXAMPLE_COLUMNS = {
    "multi_class": (None, "text", "label"),
    "multi_label": (None, "text", "labels"),
    "multiple_choice_qa": ("context", "endings", "label"),
    "summarization": ("title", "text", "summary"),
}

TASK_TYPES = {
    "billsum": "summarization",
    "case_hold": "multiple_choice_qa",
    "ecthr_a": "multi_label",
    "ecthr_b": "multi_label",
    "eurlex": "multi_label",
    "ledgar": "multi_class",
    "scotus": "multi_class",
    "unfair_tos": "multi_label",
}

CONVENTION_ARTICLES = ["2", "3", "5", "6", "8", "9", "10", "11", "14", "P1-1"]

CONCEPT_IDS = [
    "100163", "100168", "100169", "100170", "100171", "100172", "100173", "100174", "100175", "100176",
    "100177", "100179", "100180", "100183", "100184", "100185", "100186", "100187", "100189", "100190",
    "100191", "100192", "100193", "100194", "100195", "100196", "100197", "100198", "100199", "100200",
    "100201", "100202", "100204", "100205", "100206", "100207", "100212", "100214", "100215", "100220",
    "100221", "100222", "100223", "100224", "100226", "100227", "100229", "100230", "100231", "100232",
    "100233", "100234", "100235", "100237", "100238", "100239", "100240", "100241", "100242", "100243",
    "100244", "100245", "100246", "100247", "100248", "100249", "100250", "100252", "100253", "100254",
    "100255", "100256", "100257", "100258", "100259", "100260", "100261", "100262", "100263", "100264",
    "100265", "100266", "100268", "100269", "100270", "100271", "100272", "100273", "100274", "100275",
    "100276", "100277", "100278", "100279", "100280", "100281", "100282", "100283", "100284", "100285",
]

PROVISION_TYPES = [
    "Adjustments", "Agreements", "Amendments", "Anti-Corruption Laws", "Applicable Laws", "Approvals",
    "Arbitration", "Assignments", "Assigns", "Authority", "Authorizations", "Base Salary", "Benefits",
    "Binding Effects", "Books", "Brokers", "Capitalization", "Change In Control", "Closings",
    "Compliance With Laws", "Confidentiality", "Consent To Jurisdiction", "Consents", "Construction",
    "Cooperation", "Costs", "Counterparts", "Death", "Defined Terms", "Definitions", "Disability",
    "Disclosures", "Duties", "Effective Dates", "Effectiveness", "Employment", "Enforceability",
    "Enforcements", "Entire Agreements", "Erisa", "Existence", "Expenses", "Fees", "Financial Statements",
    "Forfeitures", "Further Assurances", "General", "Governing Laws", "Headings", "Indemnifications",
    "Indemnity", "Insurances", "Integration", "Intellectual Property", "Interests", "Interpretations",
    "Jurisdictions", "Liens", "Litigations", "Miscellaneous", "Modifications", "No Conflicts", "No Defaults",
    "No Waivers", "Non-Disparagement", "Notices", "Organizations", "Participations", "Payments", "Positions",
    "Powers", "Publicity", "Qualifications", "Records", "Releases", "Remedies", "Representations", "Sales",
    "Sanctions", "Severability", "Solvency", "Specific Performance", "Submission To Jurisdiction",
    "Subsidiaries", "Successors", "Survival", "Tax Withholdings", "Taxes", "Terminations", "Terms", "Titles",
    "Transactions With Affiliates", "Use Of Proceeds", "Vacations", "Venues", "Vesting",
    "Waiver Of Jury Trials", "Waivers", "Warranties", "Withholdings",
]

ISSUE_AREAS = [str(i) for i in range(1, 14)]

TERM_KINDS = [
    "Limitation of liability", "Unilateral termination", "Unilateral change", "Content removal",
    "Contract by using", "Choice of law", "Jurisdiction", "Arbitration",
]

CHOICE_NUMBERS = [str(i) for i in range(5)]

TASK_LABELS = {
    "billsum": ["This is not a labeling task"],
    "case_hold": CHOICE_NUMBERS,
    "ecthr_a": CONVENTION_ARTICLES,
    "ecthr_b": CONVENTION_ARTICLES,
    "eurlex": CONCEPT_IDS,
    "ledgar": PROVISION_TYPES,
    "scotus": ISSUE_AREAS,
    "unfair_tos": TERM_KINDS,
}
# End of fixed values.


def task_catalog(spark: SparkSession) -> DataFrame:
    """task -> example type and its three column names."""
    rows = [(task, kind, *EXAMPLE_COLUMNS[kind]) for task, kind in TASK_TYPES.items()]
    return spark.createDataFrame(rows, "task string, example_type string, col0 string, col1 string, col2 string")


def label_catalog(spark: SparkSession) -> DataFrame:
    """One row per (task, label_id, label_name); the id is the position in the task's list."""
    rows = spark.createDataFrame(list(TASK_LABELS.items()), "task string, names array<string>")
    return rows.select("task", F.posexplode("names").alias("label_id", "label_name"))


def allowed_tasks(catalog: DataFrame) -> DataFrame:
    """Tasks of the classification path: the catalog except the summarization tasks."""
    summarizing = catalog.where(F.col("example_type") == "summarization").select("task")
    return catalog.select("task").exceptAll(summarizing)


def check_task(task: str, summarization: bool = False) -> str:
    """Return the task's example type, or name the tasks that are allowed."""
    allowed = [t for t, kind in TASK_TYPES.items() if summarization or kind != "summarization"]
    if task not in allowed:
        raise ValueError(f"task ({task}) must be one of {allowed}")
    return TASK_TYPES[task]
