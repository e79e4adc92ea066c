"""Channels: bipolar partners, eligibility, candidates, montage.

Contacts are rows with a ``label`` of electrode letters and a contact number; ``keys`` name
what else tells recordings apart. Joins are equi-joins on electrode and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import contact, electrode, true_if

#: Labels that are never intracranial contacts.
NOT_CONTACTS = ("C3", "C4", "CZ", "EKG1", "EKG2", "FZ", "LOC", "ROC")


def parsed(contacts: DataFrame, label: str = "label") -> DataFrame:
    return contacts.withColumns({"electrode": electrode(F.col(label)), "number": contact(F.col(label))})


def partners(contacts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Each contact with ``alt``: the label of its electrode's next contact, or null."""
    p = parsed(contacts)
    nxt = p.groupBy(*keys, "electrode", "number").agg(F.min("label").alias("alt")).withColumn("number", F.col("number") - 1)
    return p.join(nxt, [*keys, "electrode", "number"], "left")


def pairs(contacts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``first`` and ``second`` of every bipolar pair."""
    return partners(contacts, keys).where("alt is not null").select(*keys, F.col("label").alias("first"), F.col("alt").alias("second"), "electrode", "number")


def without(contacts: DataFrame, labels: tuple[str, ...] = NOT_CONTACTS) -> DataFrame:
    return contacts.where(~true_if(F.col("label").isin(*labels)))


def eligible(contacts: DataFrame, stim: tuple[str, str], most: int | Column = 11, labels: tuple[str, ...] = NOT_CONTACTS) -> DataFrame:
    """Contacts a stimulation may spread to: the label begins with the electrode's letters, neither it nor its partner is stimulated, its number is under ``most``."""
    letters = electrode(F.lit(stim[0]))
    p = partners(without(contacts, labels))
    trailing = F.regexp_extract("label", "([0-9]+)$", 1).try_cast("int")
    return p.where(F.col("label").startswith(letters) & ~F.col("label").isin(*stim) & ~true_if(F.col("alt").isin(*stim)) & (trailing < most)).select("label", "alt")


def clip_channels(contacts: DataFrame, stim: tuple[str, str], mode: str = "electrode") -> DataFrame:
    """Contacts that a clip holds: the whole electrode in order, or the pair and its neighbours. The pair must be on one electrode."""
    if "".join(filter(str.isalpha, stim[0])) != "".join(filter(str.isalpha, stim[1])):
        raise ValueError(f"{stim[0]} and {stim[1]} aren't on one electrode")
    p = parsed(contacts).where(F.col("label").rlike("^[A-Za-z]+[0-9]+$"))
    same = p.where(F.col("electrode") == electrode(F.lit(stim[0])))
    if mode == "electrode":
        return same.select("label", "number").distinct()
    a, b = contact(F.lit(stim[0])), contact(F.lit(stim[1]))
    low, high = F.least(a, b), F.greatest(a, b)
    return same.where((F.col("number") >= 1) & F.col("number").isin(low - 1, low, high, high + 1)).select("label", "number").distinct()


def candidates(pairs_: DataFrame, stims: DataFrame, k: int = 2, keys: tuple[str, ...] = (), same_electrode: bool = True) -> DataFrame:
    """For each stimulation (``stim_id``, ``electrode``, ``a``, ``b``: contact numbers) the k nearest pairs that share no contact with it: of its electrode, or with ``same_electrode`` off of any of the recording that ``keys`` name, near by contact number."""
    if not same_electrode and not keys:
        raise ValueError("pairs of any electrode are those of one recording: name its keys")
    stims = stims.withColumnRenamed("electrode", "electrode_")
    j = pairs_.withColumn("electrode_", F.col("electrode")).join(stims, [*keys, "electrode_"]) if same_electrode else pairs_.join(stims, list(keys))
    low, high = F.col("number"), F.col("number") + 1
    free = j.where(~((F.col("electrode") == F.col("electrode_")) & (low.isin(F.col("a"), F.col("b")) | high.isin(F.col("a"), F.col("b")))))
    away = F.abs((low + high) / 2 - (F.col("a") + F.col("b")) / 2)
    w = Window.partitionBy("stim_id").orderBy("away", "number", "electrode")
    return free.withColumn("away", away).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("stim_id", "first", "second", "away", F.col("rank").cast("long").alias("rank"))


def montage(samples: DataFrame, alt: DataFrame, keys: tuple[str, ...], channel: str = "chan", value: str = "x") -> DataFrame:
    """Bipolar samples: each channel less its partner, less the mean over its window. ``alt``: channel, partner; ``keys``: window and sample."""
    other = samples.select(*keys, F.col(channel).alias("partner"), F.col(value).alias("y"))
    diff = samples.join(alt, channel, "left").join(other, [*keys, "partner"], "left").withColumn("d", F.col(value) - F.col("y"))
    mean = F.avg("d").over(Window.partitionBy(channel, keys[0]))
    return diff.select(*keys, channel, (F.col("d") - mean).alias("bipolar"))


def clicked_channels(clicks: DataFrame, baselines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``channels``: those that clicks (``keys``, ``click_id``, ``y``) fall on, each once, in order of the clicks, joined by a semicolon."""
    named = nearest_channels(clicks, baselines).join(clicks.select("click_id", *keys), "click_id")
    first = named.groupBy(*keys, "chan").agg(F.min("click_id").alias("at"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "chan"))).alias("c"))  # at most the channels of a display
    return listed.select(*keys, F.array_join(F.transform("c", lambda x: x["chan"]), ";").alias("channels"))


def nearest_channels(clicks: DataFrame, baselines: DataFrame, most: int = 4096) -> DataFrame:
    """Each click (``click_id``, ``y``) to the channel whose baseline is nearest.

    Baselines are the channels of one display; over ``most`` of them is an error."""
    held = baselines.select("base", "chan").limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"over {most} channels in one display")
    options = F.array(*(F.struct(F.abs(F.col("y") - F.lit(float(b["base"]))).alias("d"), F.lit(b["chan"]).alias("chan")) for b in held))
    return clicks.select("click_id", F.array_min(options)["chan"].alias("chan"))
