"""Summaries, letters, keys and rows against plain Python."""

import re

from pyspark.sql import functions as F

from matchflow.functions import letters, structure
from matchflow.functions import summary as S
from matchflow.functions import text as X
from matchflow.operators import layout, review


def one(spark, make, *values):
    df = spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)])
    return [r.y for r in df.select("_1", make(*(F.col(c) for c in df.columns[1:])).alias("y")).orderBy("_1").collect()]


ROLES = "array(named_struct('header', '{}', 'section', '{}', 'bullets', array({})))"


def roles(header, section, *bullets):
    quoted = ", ".join(f"'{b}'" for b in bullets) or "cast(null as string)"
    return F.expr(ROLES.format(header, section, quoted)).cast(S.ROLES)


def test_identity(spark):
    cv = roles("Account Manager", "Experience", "Grew revenue")
    got = one(spark, lambda o, n: S.identity_added(o, n, cv), ("plain", "expert in marketing"), ("plain", "in sales"), ("plain", "key account manager in marketing"), ("plain", "eager to learn marketing"), ("in marketing", "of marketing"), ("", "marketing"))
    assert got == ["marketing", None, None, None, None, None]


def test_foreign_names(spark):
    cv = "built search at Acme university in Kolkata with sql"
    texts = ["Built Search at Acme", "Studied at University of Mumbai", "Senior Product Builder", "IBM and IBMX of Kolkata", "Used SQL/NOSQL", "", "The Mumbai Mumbai mumbai office MUMBAI"]
    assert one(spark, lambda t: S.foreign_terms(t, F.lit(cv)), *texts) == [[], ["Studied", "Mumbai"], ["Senior Product Builder"], ["IBMX"], ["Used", "SQL/NOSQL"], [], ["The Mumbai Mumbai", "MUMBAI"]]
    assert one(spark, lambda t: S.foreign_terms(t, F.lit(cv), F.array(F.lit("mumbai"), F.lit("product"))), *texts[:3]) == [[], ["Studied"], []]
    assert one(spark, lambda t: S.foreign_terms(t, F.lit("")), "Mumbai") == [[]]


def test_absorbed_bullets_and_projects(spark):
    cv = roles("Cedar Ports  Tech Stack: Python", "Projects", "Drove five percent user growth and retention", "too short")
    texts = ["A builder. Drove 5 percent user growth and retention. The end.", "A builder of many things over years of work.", ""]
    assert one(spark, lambda t: S.absorbed_bullet(t, cv), *texts) == [True, False, False]
    assert one(spark, lambda o, n: S.project_dropped(o, n, cv), ("made cedar ports", "made things"), ("made cedar ports", "CEDAR PORTS too"), ("made", "made")) == ["Cedar Ports", None, None]


def test_letters_lose_template_phrases(spark):
    given = ["I'm confident that i can help. I am excited about the opportunity to build. my passion for code shows.", "My past is a strong fit for this role, as said.", "It is synergy, then.", "It is results-driven, then.", "Wait.. synergy", None]
    want = ["I can help. I would welcome the chance to build. My interest in code shows.", "My past is well suited to this role, as said.", "It is alignment, then.", "It is then.", "Wait.. Synergy", ""]
    df = spark.createDataFrame(list(enumerate(given)), "i int, t string")
    assert [r.y for r in df.select("i", letters.strip_banned("t").alias("y")).orderBy("i").collect()] == want
    assert one(spark, lambda t: letters.foreign_terms(t, F.lit("we use aws"), F.lit("Acme"), known=("CV",)), "AWS and LoadRunner, loadrunner, LoadRunner, Node.js, C++ or CV") == [["LoadRunner", "Node.js"]]


def plain_compress(text, most):
    if len(text.split()) <= most:
        return text
    parts = []
    for p in X.POSTING_PARTS:
        if m := re.search(p, text, re.I):
            end = re.search(X.POSTING_ENDS, text[m.end() :], re.I)
            part = text[m.start() : m.end() + end.start() if end else None].strip()
            if len(part.split()) > 10:
                parts.append(part)
    whole = "\n\n".join(parts) if parts else text
    cut = whole.split()
    return " ".join(cut[:most]) + "..." if len(cut) > most else whole


def test_long_postings(spark):
    body = " ".join(f"w{k}" for k in range(40))
    texts = ["short", body, f"x {body}\nRequirements: {body}\nBenefits: lots\nYour role {body}", f"intro {body} You will: {body} {body}\n  What we offer y", f"{body}\nrequirements few\nabout us: {body}", f"Qualification {body}\n\nResponsibilities:\n{body}\n"]
    for most in (20, 60, 100, 800):
        assert one(spark, lambda t, n=most: X.compress_text(t, n), *texts) == [plain_compress(t, most) for t in texts]


def test_bullets_are_repaired(spark):
    assert one(spark, structure.repair_bullets, "?  Led\n�  Built\n•\nMade it\n\n\n\nEnd?  no", " ▪ \n x") == ["• Led\n• Built\n• Made it\n\nEnd?  no", "▪ x"]


def test_keys_and_strategies(spark):
    keys = ["VoC Hub  Tech Stack: a", "Lead - North", "Lead — X | y", "Engineer: Backend", "ROLES:", " - ", "A Tools: x"]
    assert one(spark, review.normalize_key, *keys) == ["VoC Hub", "Lead", "Lead", "Engineer: Backend", None, "-", "A"]
    raw = '{"section_notes": {"Lead  x": "a", "Skills": "b", "Lead": "c"}, "bullet_strategy": {"Lead | x": [{"i": 0, "lead_with": "l", "jd_keyword": "product team ownership"}, {"i": 1, "jd_keyword": "agentic"}]}}'
    row = review.resolve_strategy(spark.createDataFrame([(raw,), ("no",)], "raw string"), "raw").collect()
    assert row[0].section_notes == {"Lead": "c"} and [a.jd_keyword for a in row[0].bullet_strategy["Lead"]] == ["", "agentic"]
    assert (row[1].summary_angle, row[1].keywords, row[1].section_notes) == ("", [], {})
    leads = spark.createDataFrame([(1, "h", 0, "The big red dog ran"), (1, "h", 1, "cut costs by half"), (1, "h", 2, " w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (1, "h", 9, "big red dog")], "doc_id int, header string, i int, lead_with string")
    bullets = spark.createDataFrame([(1, "The H role", 3, 0, "Big, red dog sat"), (1, "The H role", 3, 1, "Big red dog"), (1, "The H role", 3, 2, "x"), (1, "Oh", 7, 0, "y")], "doc_id int, header string, place int, i int, text string")
    assert {r.i: r.lead_with for r in review.clean_leads(leads, bullets).collect()} == {0: "", 1: "cut costs by half", 2: "", 9: "big red dog"}


def test_matches_recover_skills_and_obey_rules(spark):
    raw = '{"match_score": 80, "matched_skills": ["sql"], "missing_skills": ["automation workflows", "rust"], "reasoning": "r"}'
    df = spark.createDataFrame([(1, raw, "Software Engineer", 2, "3 years asked" + " of it" * 5), (2, raw, "VP Sales", 1, "3 years" + " of it" * 5), (3, raw, "Software Engineer", 1, "20 years of it" + " or so" * 5), (4, "no", "Software Engineer", 2, "x" * 30), (5, raw, "Software Engineer", 2, "x" * 29)], "i int, raw string, title string, level int, description string").withColumn("cv", F.lit("built workflow automation" + " and more" * 4))
    rows = review.resolve_match(df, "raw", "title", "level", cv="cv", description="description").orderBy("i").collect()
    assert (rows[0].matched, rows[0].missing, rows[0].score) == (["sql", "automation workflows"], ["rust"], 80)
    assert [(r.score, r.reasoning) for r in rows[1:]] == [(30, "level gap"), (25, "years asked"), (0, "no"), (0, "description too short")] and rows[1].matched == []


def test_rows_merge_by_their_top(spark):
    lines = [(1, 0, k, x, y, x + 5, y + 5, t, m) for k, (x, y, t, m) in enumerate([(10.0, 10.0, "a", False), (50.0, 10.9, "b", False), (5.0, 11.1, "*", True), (90.0, 11.8, "c", False), (10.0, 30.0, "d", False)])]
    df = spark.createDataFrame(lines, "doc_id int, page int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, is_marker boolean")
    got = sorted((r.y0, r.text, r.x1) for r in layout.merge_rows(df).collect())
    assert got == [(10.0, "a   b", 55.0), (11.1, "*", 10.0), (11.8, "c", 95.0), (30.0, "d", 15.0)]
