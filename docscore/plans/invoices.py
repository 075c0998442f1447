"""Invoice texts made from orders, whose true record is known.

Every order becomes a text for the label-anchored extractor and one for the
format-first extractor. Labels, separators of dates and of numbers, and what is
missing vary with the order's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docscore.plans import facts as P

LETTERS = "אבגדהוזחטי"


def _grouped(money: Column, form: Column) -> Column:
    """An amount in one of three forms: plain, with commas, with dots for commas."""
    commas = F.format_number(money.cast("decimal(20,2)"), 2)
    return F.when(form == 0, money).when(form == 1, commas).otherwise(F.replace(commas, F.lit(","), F.lit(".")))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, label_text, strict_text, format_text``; a row per order, dealt over all cores, as reading a text takes long."""
    t = P.truths(spark, sf_dir).repartition("key")
    key = F.col("key")
    # not from the tax id: that is cut to nine digits
    name = F.concat(F.lit("חברת "), F.translate("custkey", "0123456789", LETTERS))
    day = lambda sep: F.concat_ws(sep, F.substring("invoice_date", 9, 2), F.substring("invoice_date", 6, 2), F.substring("invoice_date", 1, 4))
    date = F.when(key % 3 == 0, day("/")).when(key % 3 == 1, day(".")).otherwise(day("-"))
    said = lambda label, value: F.concat(F.lit(label), value)

    def labelled(form: Column) -> Column:
        money = lambda f: _grouped(F.col(f), form)
        return _lines(
            said("", F.concat(name, F.lit(' בע"מ'))),
            F.when(key % 4 < 2, said("עוסק מורשה ", F.col("business_tax_id"))).otherwise(said("ח.פ. ", F.col("business_tax_id"))),
            said("חשבונית מס ", F.col("invoice_number")),
            F.when(key % 3 == 0, said("תאריך ", date)).when(key % 3 == 1, said("הופק 01.01.2001\nהעברה בנקאית ", date)).otherwise(said("הופק ", date)),
            said('סה"כ ', money("amount_before_vat")), said('מע"מ ', money("vat_amount")), said("לתשלום ", money("total_amount")),
            said("מספר הקצאה ", F.col("allocation_number")),
        )

    iso = F.when(key % 4 == 3, F.col("invoice_date")).when(key % 2 == 0, day("/")).otherwise(day("-"))
    money = lambda f: _grouped(F.col(f), key % 3)
    free = _lines(
        said("לכבוד: ", name), said("ח.פ. ", F.col("business_tax_id")), said("חשבונית מס ", F.concat("invoice_number", F.lit(" מקור"))), said("תאריך ", iso),
        said("סכום ", money("amount_before_vat")), said('מע"מ ', F.concat(money("vat_amount"), F.lit(" ( 18.00 % )"))), said("לתשלום ", money("total_amount")), F.col("allocation_number"),
    )
    return t.select("key", labelled(key % 3).alias("label_text"), labelled(F.lit(1)).alias("strict_text"), free.alias("format_text"))


def odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, text``: recognised texts whose amounts do not add up, or where one is found without its label.

    By the key modulo 4: a total that is fifty too much, a net amount on a line of its
    own, a tax amount known by its percentage only, and a text that is as it should be.
    """
    t = P.truths(spark, sf_dir).repartition("key")
    kind = F.col("key") % 4
    total = F.when(kind == 0, (F.col("total_amount").cast("decimal(20,2)") + 50).cast("string")).otherwise(F.col("total_amount"))
    net = F.when(kind == 1, F.concat(F.lit("שורה "), "amount_before_vat")).otherwise(F.concat(F.lit('סה"כ '), "amount_before_vat"))
    tax = F.when(kind == 2, F.concat("vat_amount", F.lit(" ( 18.00 % )"))).otherwise(F.concat(F.lit('מע"מ '), "vat_amount"))
    text = _lines(F.concat(F.lit("חשבונית מס "), "invoice_number"), net, tax, F.concat(F.lit("לתשלום "), total))
    return t.select("key", text.alias("text"))


VENDOR_SQL = f"'חברת ' || translate(CAST(o_custkey AS VARCHAR), '0123456789', '{LETTERS}')"
