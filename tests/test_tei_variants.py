"""Other readings of TEI documents, on small ones with known values."""

from lectern.sources import tei_variants as V

HEAD = '<TEI xmlns="http://www.tei-c.org/ns/1.0">'
FULL = f"""{HEAD}<teiHeader><fileDesc><titleStmt><title>Foo <hi>bar</hi></title></titleStmt><publicationStmt><date when="2020-01-02"/></publicationStmt><sourceDesc><biblStruct><analytic>
<author><persName><forename>Ann</forename><surname>Lee</surname></persName><email>a@b.org</email><idno type="ORCID">0000-1</idno><affiliation><orgName>Uni X</orgName></affiliation></author>
<author><persName><surname>Solo</surname></persName></author></analytic><monogr><title level="j">J of T</title><imprint><date when="1850"/></imprint></monogr><idno type="DOI">10.1/x</idno></biblStruct></sourceDesc></fileDesc>
<profileDesc><abstract><p>short</p></abstract></profileDesc></teiHeader><text><body><div><head>Abstract it</head><p>a<b>c<d>e</d>f</b>g</p></div><div><head>A</head><p>a</p><div><head>B</head><p>b</p></div></div>
<figure type="figure"><figDesc>Cap</figDesc></figure><formula>E=mc</formula></body><back><div type="acknowledgement"><p>NIH-R01 and grant AB-12</p></div></back></text></TEI>"""


def test_direct_sections_have_their_own_paragraphs():
    got = V.read(FULL.encode())
    assert [(s["title"], s["text"]) for s in got["direct"]["sections"]] == [("Abstract it", "a c e f g"), ("A", "a"), ("B", "b"), (None, "NIH-R01 and grant AB-12")]
    assert got["direct"]["ids"] == {"orcid": "0000-1", "doi": "10.1/x"} and got["direct"]["title"] == "Foo"
    assert [a["name"] for a in got["direct"]["authors"]] == ["Ann Lee"]


def test_walk_puts_tails_behind_their_element():
    assert V.read(FULL.encode())["guarded_abstract"].split() == ["Abstract", "it", "a", "c", "g", "e", "f"]
    long = FULL.replace("<p>short</p>", f"<p>{'word ' * 40}</p>")
    assert V.read(long.encode())["guarded_abstract"].startswith("word word")


def test_year_takes_the_first_place_without_a_range():
    assert V.read(FULL.encode())["tei_year"] == 1850
    assert V.read(f'{HEAD}<note><date when="1700"/><date>in 1999</date></note></TEI>'.encode())["tei_year"] == 1999
    assert V.read(f"{HEAD}<note/></TEI>".encode())["tei_year"] is None


def test_groups_and_projections(spark):
    rows = spark.createDataFrame([("p", FULL), ("bad", "<TEI>"), ("none", None)], "paper_id string, xml string")
    read = V.read_variants(rows)
    got = V.entity_groups(read).collect()
    assert [r.paper_id for r in got] == ["p"]
    r = got[0]
    assert (r.persons, r.organizations, r.emails, r.funding, r.equations) == (["Ann Lee", "Solo"], ["Uni X"], ["a@b.org"], ["AB-12", "R01"], ["E=mc"])
    assert r.total_entities == 1 + sum(len(r[g]) for g in V.GROUPS)
    assert sum(1 for x in read.collect() if x.parse_error) == 2
    out = V.projections(rows, read)
    assert list(out) == ["complete", "entities", "metadata", "sections", "coordinates", "structure", "statistics"]
    assert [x.title for x in out["sections"].orderBy("pos").collect()] == ["Abstract it", "A", "B"] and out["coordinates"].count() == 0
    assert V.read_variants(rows.limit(0)).count() == 0
