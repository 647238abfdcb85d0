"""Parts that the SQL of several queries shares."""

INV = """inv AS (SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY batch_no DESC, scanned_at DESC) AS r
  FROM files WHERE path IS NOT NULL AND file_id IS NOT NULL) WHERE r = 1)"""
DUP = INV + """,
dup AS (SELECT * FROM inv WHERE class_id IS NOT NULL AND NOT starts_with(class_id, 'u:') AND size IS NOT NULL)"""
ANC = """anc AS (SELECT i.*, array_to_string(parts[1:k], '/') AS above FROM
  (SELECT *, string_split(path, '/') AS parts FROM inv) i, unnest(range(2, len(parts))) AS t(k))"""


def category(path: str, report: bool = False) -> str:
    """SQL of the category of ``path``."""
    from stratafold.functions.text import CATEGORIES, REPORT_EXTRA

    cases = []
    for key, suffixes in CATEGORIES.items():
        if report:
            listed = ", ".join(f"'{s}'" for s in suffixes + REPORT_EXTRA.get(key, []))
            cases.append(f"WHEN lower(regexp_extract(regexp_extract({path}, '[^/]*$'), '^\\.*[^.].*(\\.[^.]*)$', 1)) IN ({listed}) THEN '{key}'")
        else:
            listed = "|".join(s[1:] for s in suffixes)
            cases.append(f"WHEN regexp_matches(rtrim(lower({path}), '/'), '\\.({listed})$') THEN '{key}'")
    return "CASE " + " ".join(cases) + " ELSE 'other' END"


def problem(text: str) -> str:
    from stratafold.functions.text import OTHER_PROBLEM, PROBLEMS

    cases = " ".join("WHEN " + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + f" THEN '{title}'" for words, title in PROBLEMS)
    return f"CASE {cases} ELSE '{OTHER_PROBLEM}' END"
