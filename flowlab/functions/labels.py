"""Label expressions: raw log label to class name, fine label to coarse class."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import bind, strip

BENIGN = "Benign"

# Fine label (upper case) to coarse class.
COARSE_CLASSES = {
    "DDOS-ACK_FRAGMENTATION": "DDoS",
    "DDOS-HTTP_FLOOD": "DDoS",
    "DDOS-ICMP_FLOOD": "DDoS",
    "DDOS-ICMP_FRAGMENTATION": "DDoS",
    "DDOS-PSHACK_FLOOD": "DDoS",
    "DDOS-RSTFINFLOOD": "DDoS",
    "DDOS-SLOWLORIS": "DDoS",
    "DDOS-SYN_FLOOD": "DDoS",
    "DDOS-SYNONYMOUSIP_FLOOD": "DDoS",
    "DDOS-TCP_FLOOD": "DDoS",
    "DDOS-UDP_FLOOD": "DDoS",
    "DDOS-UDP_FRAGMENTATION": "DDoS",
    "DOS-HTTP_FLOOD": "DoS",
    "DOS-SYN_FLOOD": "DoS",
    "DOS-TCP_FLOOD": "DoS",
    "DOS-UDP_FLOOD": "DoS",
    "MIRAI-GREETH_FLOOD": "Mirai",
    "MIRAI-GREIP_FLOOD": "Mirai",
    "MIRAI-UDPPLAIN": "Mirai",
    "RECON-HOSTDISCOVERY": "Recon",
    "RECON-OSSCAN": "Recon",
    "RECON-PINGSWEEP": "Recon",
    "RECON-PORTSCAN": "Recon",
    "MITM-ARPSPOOFING": "Spoofing",
    "DNS_SPOOFING": "Spoofing",
    "SQLINJECTION": "WebAttack",
    "COMMANDINJECTION": "WebAttack",
    "XSS": "WebAttack",
    "UPLOADING_ATTACK": "WebAttack",
    "BROWSERHIJACKING": "WebAttack",
    "BACKDOOR_MALWARE": "WebAttack",
    "DICTIONARYBRUTEFORCE": "WebAttack",
    "VULNERABILITYSCAN": "WebAttack",
    "BENIGN": "Benign",
}

# Label texts without content.
_EMPTY_WHOLE = ("", "-", "(empty)", "nan")
_EMPTY_PART = ("", "-", "(empty)")


def parse_zeek_label(raw: Column) -> Column:
    """Class name of a raw log label, e.g. ``(empty)   Malicious   DDoS`` to ``DDoS``.

    Parts are separated by tabs, or else by three spaces.  Built from expressions
    only, so it stays inside the JVM.
    """

    def by_words(words: Column) -> Column:
        attack_at = F.array_position(words, "Malicious")
        last = F.get(words, F.size(words) - 1)
        return (
            F.when(F.size(words) == 0, F.lit(BENIGN))
            .when(attack_at > 0, F.coalesce(F.get(words, attack_at.cast("int")), F.lit("Malicious_Unknown")))
            .when(F.lower(last) == BENIGN.lower(), F.lit(BENIGN))
            .otherwise(last)
        )

    def by_text(text: Column) -> Column:
        tabbed = text.contains("\t")
        pieces = F.when(tabbed, F.split(text, "\t")).otherwise(F.split(text, " {3}"))
        words = F.filter(F.transform(pieces, strip), lambda w: ~w.isin(*_EMPTY_PART))
        whole = F.when(F.lower(text).isin(*_EMPTY_WHOLE), F.lit(BENIGN)).otherwise(text)
        return F.when(~tabbed & ~text.contains("   "), whole).otherwise(bind(words, by_words))

    return F.when(raw.isNull(), F.lit(BENIGN)).otherwise(bind(strip(raw), by_text))


def coarse_label(raw: Column, classes: dict[str, str] = COARSE_CLASSES) -> Column:
    """Coarse class of a fine label, ignoring case and outer spaces; '' when unknown.

    The mapping is a constant of a few dozen entries, so it is a literal map and
    needs no join.  Use ``map_labels`` for a mapping held in a table.
    """
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(classes.items())])
    return F.coalesce(F.try_element_at(entries, F.upper(strip(raw))), F.lit(""))


def class_table(spark: SparkSession, classes: dict[str, str] = COARSE_CLASSES) -> DataFrame:
    """A label mapping as a table ``(fine, coarse)``, for joins."""
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(classes.items())])
    return spark.range(1).select(F.explode(entries).alias("fine", "coarse"))
