"""Small lookup tables, from YAML files of a folder that the caller names, and the few that are fixed here."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

#: Weaknesses of scanner rules.
RULE_CWES = {
    "js/xss-through-dom": "CWE-79", "js/untrusted-data-to-external-api": "CWE-20", "js/html-constructed-from-input": "CWE-79", "js/xss": "CWE-79",
    "js/regex/missing-regexp-anchor": "CWE-20", "js/unsafe-jquery-plugin": "CWE-79", "js/path-injection": "CWE-22",
    "js/incomplete-url-scheme-check": "CWE-20", "js/useless-regexp-character-escape": "CWE-20", "js/overly-large-range": "CWE-20",
    "js/incomplete-url-substring-sanitization": "CWE-20", "js/reflected-xss": "CWE-79", "js/biased-cryptographic-random": "CWE-327",
    "js/server-crash": "CWE-730", "js/remote-property-injection": "CWE-400", "js/unnecessary-use-of-cat": "CWE-78",
    "js/client-side-unvalidated-url-redirection": "CWE-601", "js/stored-xss": "CWE-79", "js/disabling-certificate-validation": "CWE-295",
    "js/request-forgery": "CWE-918", "js/server-side-unvalidated-url-redirection": "CWE-601", "js/zipslip": "CWE-22",
    "js/incorrect-suffix-check": "CWE-20", "js/weak-cryptographic-algorithm": "CWE-327", "js/file-access-to-http": "CWE-200",
    "js/exposure-of-private-files": "CWE-200", "js/code-injection": "CWE-94",
}
#: File extensions of languages.
LANGUAGE_EXTENSIONS = {
    "Objective-C": ["m", "mm"], "Java": ["java", "jsp", "jspf"], "Scala": ["scala"],
    "C/C++": ["c", "cc", "cxx", "cpp", "hpp", "c++", "h", "hh", "cppm", "ixx", "cp", "inl"], "Groovy": ["groovy"],
    "PHP": ["php", "tpl", "inc", "ctp", "phpt", "phtml"], "JavaScript": ["js", "jsx", "coffee"], "Python": ["py"],
    "Config files": ["lock", "gradle", "json", "config", "yaml", "conf"], "Ruby": ["rb"], "HTML": ["html", "erb"], "Perl": ["pm"], "Go": ["go"],
    "Lua": ["lua"], "Erlang": ["erl"], "C#": ["cs"], "Rust": ["rust"], "Vala": ["vala"], "SQL": ["sql"], "XML": ["xml"], "Shell": ["sh"],
}


def load_lookups(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of the YAML files below folder, each row small and each table fit to be broadcast.

    Names: extension_language, bug_class, sw_category, fault_cluster, cwe_abstraction, security_keyword, software_type.
    A file that is missing gives no table.
    """
    read = lambda name: yaml.safe_load((Path(folder) / name).read_text()) if (Path(folder) / name).exists() else None
    out: dict[str, DataFrame] = {}
    if mappings := read("mappings.yml"):
        out |= mapping_tables(spark, mappings["mappings"])
    if abstractions := read("abstractions.yml"):
        rows = [(str(cwe), str(kind), str(level) if level is not None else None) for kind, own in abstractions["abstractions"].items()
                for cwe, level in (own.items() if isinstance(own, dict) else ((c, None) for c in own))]
        out["cwe_abstraction"] = spark.createDataFrame(rows, "cwe_id string, kind string, abstraction string")
    if keywords := read("keywords.yml"):
        out["security_keyword"] = spark.createDataFrame([(str(k),) for k in keywords["keywords"]["security"]], "keyword string")
    if types := read("sw_type.yml"):
        rows = [(str(o), str(p), str(t)) for o, own in types["sw_type"].items() for p, t in own.items()]
        out["software_type"] = spark.createDataFrame(rows, "owner string, project string, sw_type string")
    return out


def mapping_tables(spark: SparkSession, mappings: dict) -> dict[str, DataFrame]:
    languages = [(i, name, str(e)) for i, (name, own) in enumerate(mappings.get("extensions", {}).items()) for e in own]
    classes = [(category, c, operation, int(cwe), title) for category, own in mappings.get("bugs_framework", {}).items() for c, ops in own.items()
               for operation, entries in ops.items() for cwe, title in (entries or {}).items()]
    categories = [(int(c), own["title"], int(cwe)) for c, own in mappings.get("software_development", {}).items() for cwe in own["entries"]]
    clusters, patterns = [], mappings.get("software_fault_pattern", {})
    parents = {int(s): (int(c), own["title"]) for c, own in patterns.get("primary", {}).items() for s in own.get("clusters", {})}
    for level, groups in patterns.items():
        for c, own in groups.items():
            parent = parents.get(int(c), (None, None))
            clusters += [(level, int(c), own["title"], *parent, int(cwe)) for cwe in own.get("entries", {})]
    return {
        "extension_language": spark.createDataFrame(languages, "ord int, language string, extension string"),
        "bug_class": spark.createDataFrame([(i, *r) for i, r in enumerate(classes)], "ord int, category string, bf_class string, operation string, cwe int, title string"),
        "sw_category": spark.createDataFrame(categories, "category int, title string, cwe int"),
        "fault_cluster": spark.createDataFrame(clusters, "level string, cluster int, title string, parent_cluster int, parent_title string, cwe int"),
    }
