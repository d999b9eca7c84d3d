"""Registered queries over free text and JSON paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe.functions.prose import mask_prose, prose_log, prose_scan
from maskframe.operators.mask import mask
from maskframe.plans import fixtures as X
from maskframe.plans.queries import NO_RULES, customers, query
from maskframe.policy import MaskPolicy, Rule


def letters(spark, d):
    """A letter to every customer with an e-mail, full of personal data and of look-alikes."""
    return customers(spark, d).where("email is not null").select(
        "c_custkey",
        "email",
        F.concat(
            F.lit("Dear customer "), "c_custkey", F.lit(", write to <"), "email", F.lit("> or call "), "phone",
            F.lit(". Your card "), "credit_card", F.lit(" was used from "), "client_ip", F.lit("; SSN:"), "ssn",
            F.lit(", passport ("), "passport_no", F.lit("), v"), "client_ip", F.lit(".7 "), "notes",
        ).alias("letter"),
    )


@query
def mask_prose_documents(spark, d):
    """Whole texts with fakes in place of personal data."""
    return X.table(spark, d, "documents").select("doc_id", mask_prose("text").alias("text"))


@query
def mask_prose_pages(spark, d):
    """The same in web pages."""
    return X.table(spark, d, "pages").select("page_id", mask_prose("html").alias("html"))


@query
def mask_prose_letters(spark, d):
    """By a rule; every kind of value, and digits that are none."""
    policy = MaskPolicy((Rule(None, "letter", "prose"),))
    return mask(letters(spark, d).select("c_custkey", "letter"), policy)


@query
def mask_prose_join(spark, d):
    """The fake in a text is the fake of the same value in a column."""
    policy = MaskPolicy((Rule(None, "letter", "prose"),))
    masked = mask(letters(spark, d).select("c_custkey", "letter"), policy)
    people = mask(customers(spark, d).where("email is not null").select("c_custkey", "email"), NO_RULES)
    said = F.regexp_extract("letter", "write to <([^>]*)>", 1)
    joined = people.join(masked.select("c_custkey", said.alias("said")), "c_custkey")
    return joined.select("c_custkey", "email", (F.col("said") == F.col("email")).alias("mentioned"))


@query
def prose_scan_documents(spark, d):
    """Pieces of each type anywhere in the texts."""
    return prose_scan(X.table(spark, d, "documents"), "text")


@query
def prose_log_documents(spark, d):
    """What is replaced in each text."""
    return prose_log(X.table(spark, d, "documents"), "text", ("doc_id",))
