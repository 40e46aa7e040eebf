from chatterloom.llm import aliases

SAME = [
    ["Małgorzata Klenízemey", "Gosia Klenízemey", "KLENÍZEMEY, Małgorzata", "malgorzata.klenizemey", "M. Klenízemey", "Klenízemey M.", "Dr Małgorzata Klenízemey",
     "MałgorzataKlenízemey", "Małgorzata Klenízmeey", "Małgorzata K. Klenízemey 🌻", "Małgorzata Klenízemey - new number", "MaÅ‚gorzata KlenÃ\xadzemey", "Мałgorzata Klenízemey"],
    ["Archibald Klenízemey", "Archie Klenízemey"],
    ["Marrowgate Allotment Society", "marrowgate allotment society", "The Marrowgate Allotment Society", "Marrowgate Allotment Society Ltd", "Allotment Society Marrowgate", "Marowgate Allotment Society"],
    ["Gofakevey Community Choir", "Gofakevey Comm. Choir"],
    ["Bekilivan Veterinary Clinic", "Bekilivan Vets"], ["Drutuvemey Cycling Club Ltd", "Drutuvemey CC"], ["Vanimimez Swimming Association", "Vanimimez Swim Assoc."],
    ["Napüsilberg Plumbing", "Napusilberg Plmbg"],
    ["José Daloseney"], ["Joseph Daloseney"], ["😂"], ["🌻"], ["+44 7700 900123", "+447700900123"], ["+44 7700 900124"], ["\u200b"], ["Victoria Lozivasan"], ["Michael Lozivasan"],
]


def test_links(spark):
    rows = [(x, 50 if i == 0 else 3) for g in SAME for i, x in enumerate(g)]
    rows += [(f"{g} Drob{s}ov", 5) for g in ("José", "Joseph") for s in ("eva", "uni", "iso", "oka", "amu")]
    got = {r.name: r.entity for r in aliases.link(spark.createDataFrame(rows, "name string, n long")).collect()}
    assert len(got) == len(rows)
    for g in SAME:
        assert len({got[x] for x in g}) == 1, [(x, got[x]) for x in g]
    assert len({got[g[0]] for g in SAME}) == len(SAME)


def test_clipped_names_go_by_shares(spark):
    last = ["Drobeva", "Klenizemey", "Lozivasan", "Daloseney", "Stekivulund", "Vanimimez", "Napusilberg", "Tolverton"]
    rows = [(f"Quorlinda {s}", 50) for s in last] + [(f"Quorlin {s}", 3) for s in last[:4]]  # half as common, by few classes
    rows += [(f"{g} {s}", 5) for g in ("Zemaro", "Zemaroque") for s in last]  # as common as each other
    got = {r.name: r.entity for r in aliases.link(spark.createDataFrame(rows, "name string, n long")).collect()}
    assert all(got[f"Quorlin {s}"] == got[f"Quorlinda {s}"] for s in last[:4])
    assert all(got[f"Zemaro {s}"] != got[f"Zemaroque {s}"] for s in last)


def test_found_pairs_and_empty(spark):
    m = spark.createDataFrame([("Ann Lee", "x"), ("Lee, Ann", "x"), (None, "x"), ("", "x"), ("Ann Lee", "x")], "sender string, name string")
    p = spark.createDataFrame([("A. Lee",), (None,)], "who string")
    got = sorted(map(tuple, aliases.aliases_found(m, p).collect()))
    assert got == [("A. Lee", "Ann Lee"), ("A. Lee", "Lee, Ann"), ("Ann Lee", "Lee, Ann")]
    assert aliases.aliases_found(m.where("false"), p.where("false")).count() == 0


def test_typo():
    assert all(aliases.one_typo("stekivulund", x) for x in ("stekivulund", "stekivlund", "setkivulund", "stekivulumd", "stekivuulund"))
    assert not aliases.one_typo("stekivulund", "stkeivlund") and not aliases.one_typo("ab", "b")


def entities(spark, rows):
    return {r.name: r.entity for r in aliases.link(spark.createDataFrame(rows, "name string, n long")).collect()}


def test_short_forms_and_organisations_nobody_listed(spark):
    same = [
        ("James Tolverhart", "Jim Tolverhart"), ("Stephen Quorl", "Steve Quorl"), ("David Brenmoor", "Dave Brenmoor"), ("Richard Halvesey", "Dick Halvesey"), ("John Pellivan", "Jack Pellivan"),
        ("Robert van Dyke", "Bob van Dyke"), ("International Business Machines", "IBM"), ("Riverside Dental Practice", "Riverside Dental"), ("Kettleby Engineering", "Kettleby Engng"), ("Samuel Okonjo", "Sam Okonjo"),
        ("Oakham Amateur Dramatics Guild", "Oakham ADG"), ("Vexley Photographic Institute", "Vexley Photo. Inst."),
    ]
    got = entities(spark, [(x, 40 if i == 0 else 6) for pair in same for i, x in enumerate(pair)])
    for a, b in same:
        assert got[a] == got[b], (a, b)
    assert len(set(got.values())) == len(same)


def test_names_of_their_own_stay_apart_unless_the_data_carry_them(spark):
    apart = [("Liam Carter", "William Carter"), ("Susan Hall", "Susannah Hall"), ("Vera Rossi", "Veronica Rossi")]
    got = entities(spark, [(x, 50) for pair in apart for x in pair])
    assert all(got[a] != got[b] for a, b in apart)
    # where nearly everybody called so has the full name as well, it is a short form
    last = ["Drobeva", "Klenizemey", "Lozivasan", "Daloseney", "Stekivulund", "Vanimimez", "Napusilberg", "Tolverton"]
    got = entities(spark, [(f"{g} {s}", 50 if g == "William" else 9) for g in ("William", "Liam") for s in last])
    assert all(got[f"Liam {s}"] == got[f"William {s}"] for s in last)


def test_a_label_without_letters_never_meets_the_parts_of_another(spark):
    got = entities(spark, [("a b", 3), ("A B", 2), ("b", 1), ("!!", 1), ("?!", 2), ("The", 1)])
    assert got["!!"] != got["?!"] and got["a b"] == got["A B"] and got["The"] not in (got["b"], got["!!"])
