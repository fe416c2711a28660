"""Event templates of log messages: by masks alone, or mined by a fixed-depth tree."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.config import ParsingConfig
from stratalog.functions.patterns import to_java
from stratalog.operators.preprocess import once
from stratalog.operators.scans import numbered

# The masks of a run that sets none.
DEFAULT_MASKS = [
    {"regex_pattern": r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "mask_with": "ID"},
    {"regex_pattern": r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "mask_with": "IP"},
    {"regex_pattern": r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)", "mask_with": "HEX"},
    {"regex_pattern": r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "mask_with": "NUM"},
]

#: The token that stands for differing ones.
WILDCARD = "<*>"


def masked(content: Column, config: ParsingConfig) -> Column:
    """content with each mask's matches replaced, mask after mask."""
    for rule in config.masking_rules:
        instead = f"{config.mask_prefix}{rule['mask_with']}{config.mask_suffix}"
        content = F.regexp_replace(content, to_java(rule["regex_pattern"]), instead.replace("\\", r"\\").replace("$", r"\$"))
    return content


def tokens(content: Column, config: ParsingConfig) -> Column:
    """Words of content, the extra delimiters being blanks."""
    for d in config.extra_delimiters or []:
        content = F.replace(content, F.lit(d), F.lit(" "))
    return F.filter(F.split(content, r"\s+"), lambda t: t != "")


def _checked(rows: DataFrame) -> DataFrame:
    if "Content" not in rows.columns:
        raise ValueError("Input DataFrame must have 'Content' column")
    return rows.withColumn("Content", F.col("Content").cast("string")).where("Content IS NOT NULL")


def _order(rows: DataFrame) -> list[str]:
    return [c for c in ("Timestamp", "line_no") if c in rows.columns] or ["Content"]


def masked_templates(rows: DataFrame, config: ParsingConfig) -> DataFrame:
    """rows with EventTemplate (masked content), TemplateId (by first appearance) and
    Parameters (what the masks matched).

    Templates are first reduced to one row each and numbered by a scan; the numbers join back
    by template.
    """
    rows = once(_checked(rows), "EventTemplate", masked(F.col("Content"), config))
    patterns = [f"(?:{to_java(r['regex_pattern'])})" for r in config.masking_rules]
    found = F.regexp_extract_all("Content", F.lit("|".join(patterns)), F.lit(0)) if patterns else F.array()
    rows = rows.withColumn("Parameters", found.cast("array<string>"))
    first = rows.groupBy("EventTemplate").agg(F.min(F.struct(*_order(rows))).alias("_first"))
    ids = numbered(first, ["_first", "EventTemplate"], "_nth").select("EventTemplate", (F.col("_nth") + 1).alias("TemplateId"))
    joined = rows.join(ids, "EventTemplate")
    return joined.select(*[c for c in rows.columns if c not in ("EventTemplate", "Parameters")], "EventTemplate", "TemplateId", "Parameters")


class TemplateTree:
    """Templates of one stream of messages, kept by a tree of fixed depth.

    A message's tokens lead by their number and then by the first tokens to a leaf; of its
    templates the most similar takes the message if it shares enough tokens, and tokens that
    differ become wildcards. Above the set number of templates the one unused for longest goes.
    """

    def __init__(self, config: ParsingConfig):
        self.config, self.levels = config, max(config.depth - 3, 0) + 1
        self.leaves: dict[tuple, list[int]] = {}
        self.children: dict[tuple, set[str]] = {}
        self.templates: OrderedDict[int, tuple[tuple, list[str]]] = OrderedDict()
        self.last = 0

    def _leaf(self, words: list[str]) -> tuple:
        path: tuple = (len(words),)
        for word in words[: self.levels]:
            known = self.children.setdefault(path, set())
            if any(c.isdigit() for c in word) or word not in known and len(known) >= self.config.max_children:
                word = WILDCARD
            else:
                known.add(word)
            path += (word,)
        return path

    def add(self, words: list[str]) -> tuple[int, str]:
        """(id, template) of a message, after it was taken in."""
        leaf = self._leaf(words)
        best, score = None, (-1.0, -1)
        for i in self.leaves.get(leaf, ()):
            template = self.templates[i][1]
            same = sum(a == b for a, b in zip(template, words))
            found = (same / len(words) if words else 1.0, template.count(WILDCARD))
            if found > score:
                best, score = i, found
        if best is None or score[0] < self.config.similarity_threshold:
            self.last += 1
            best = self.last
            self.templates[best] = (leaf, list(words))
            self.leaves.setdefault(leaf, []).append(best)
            if len(self.templates) > self.config.max_clusters:
                old, (old_leaf, _) = self.templates.popitem(last=False)
                self.leaves[old_leaf].remove(old)
        else:
            template = self.templates[best][1]
            template[:] = [a if a == b else WILDCARD for a, b in zip(template, words)]
        self.templates.move_to_end(best)
        return best, " ".join(self.templates[best][1])


def parameters(content: Column, template: Column, config: ParsingConfig) -> Column:
    """What stands in a message, its words one blank apart, for each wildcard or mask of its
    template; none where the rest of the template does not fit."""
    mark = "|".join(f"\\Q{a}\\E{b}" for a, b in ((WILDCARD, ""), (config.mask_prefix, f".+?\\Q{config.mask_suffix}\\E")))
    fixed = F.split(template, mark)
    quoted = F.transform(fixed, lambda x: F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")))
    pattern = F.concat(F.lit(r"(?s)\A\Q"), F.array_join(quoted, r"\E(.+?)\Q"), F.lit(r"\E\z"))
    groups = F.transform(F.sequence(F.lit(1), F.size(fixed) - 1), lambda i: F.concat(F.lit("$"), i.cast("string")))
    words = F.array_join(tokens(content, config), " ")
    found = F.split(F.regexp_replace(words, pattern, F.array_join(groups, "\u0001")), "\u0001")
    none = F.array().cast("array<string>")
    return F.when((F.size(fixed) > 1) & F.regexp(words, pattern), found).otherwise(none)


def mined_templates(rows: DataFrame, config: ParsingConfig, stream: str | None = None) -> DataFrame:
    """rows with EventTemplate, TemplateId and Parameters, mined in order within each stream.

    The order of messages decides, so a stream is read by one task; the task reads it sorted
    and keeps the templates only, at most max_clusters. EventTemplate is the template as it
    was when the row was seen. For streams too long for that, see mining.merged_templates.
    """
    rows = _checked(rows)
    rows = rows.withColumn("_words", tokens(masked(F.col("Content"), config), config))
    schema = T.StructType(
        [f for f in rows.schema.fields if not f.name.startswith("_")]
        + [T.StructField("EventTemplate", T.StringType()), T.StructField("TemplateId", T.LongType())]
    )

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, at = None, None
        for batch in batches:
            ids, names = [], []
            keys = batch[stream].tolist() if stream else [None] * len(batch)
            for key, words in zip(keys, batch["_words"]):
                if tree is None or key != at:
                    tree, at = TemplateTree(config), key
                i, name = tree.add(list(words))
                ids.append(i)
                names.append(name)
            yield batch.drop(columns=["_words"]).assign(EventTemplate=names, TemplateId=ids)

    keys = [stream] if stream else []
    placed = rows.repartition(*keys) if keys else rows.repartition(1)
    mined = placed.sortWithinPartitions(*keys, *_order(rows)).mapInPandas(mine, schema)
    return mined.withColumn("Parameters", parameters(F.col("Content"), F.col("EventTemplate"), config))


def distinct_templates(rows: DataFrame, config: ParsingConfig, stream: str | None = None) -> DataFrame:
    """As mined_templates, but each distinct masked message of a stream is mined once, in
    order of first appearance, and rows get the final template of its id.

    Only distinct messages pass through one task; lines are counted and joined in parallel.
    """
    rows = once(_checked(rows), "_masked", masked(F.col("Content"), config))
    keys = [stream] if stream else []
    order = _order(rows)
    first = rows.groupBy(*keys, "_masked").agg(F.min(F.struct(*order)).alias("_first"))
    messages = first.select(*keys, F.col("_masked").alias("Content"), *[F.col(f"_first.{c}").alias(c) for c in order if c != "Content"])
    mined = mined_templates(messages, ParsingConfig(**(vars(config) | {"masking_rules": []})), stream)
    last = mined.groupBy(*keys, "TemplateId").agg(F.max_by("EventTemplate", F.struct(*order)).alias("EventTemplate"))
    by_message = mined.select(*keys, F.col("Content").alias("_masked"), "TemplateId").join(last, [*keys, "TemplateId"])
    joined = rows.join(by_message, [*keys, "_masked"])
    out = joined.withColumn("Parameters", parameters(F.col("Content"), F.col("EventTemplate"), config))
    return out.select(*[c for c in rows.columns if c != "_masked"], "EventTemplate", "TemplateId", "Parameters")


def extract_templates(rows: DataFrame, config: ParsingConfig, stream: str | None = None) -> DataFrame:
    """Templates by the config's mode: masked, drain, drain_distinct, or drain_merged."""
    from stratalog.operators.mining import merged_templates

    modes = {"masked": masked_templates, "drain": mined_templates, "drain_distinct": distinct_templates, "drain_merged": merged_templates}
    if config.mine not in modes:
        raise ValueError(f"Unknown template mode {config.mine!r}; one of {sorted(modes)}")
    return masked_templates(rows, config) if config.mine == "masked" else modes[config.mine](rows, config, stream)
