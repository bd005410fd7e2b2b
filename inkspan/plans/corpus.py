"""Raw records made from the driver's tables: one for each document, in all families of formats, and broken ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: In every abstract's second paragraph: nested marks, an element without a Markdown form, an entity.
MADE_OF = "Made of <b>steel</b> and <i>H<sub>2</sub>O</i>, &ldquo;pure&rdquo;."


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records say, one row for each document: doc_id, family (doc_id mod 6), turn (doc_id div 6), number, kind, filed,
    title, first (line of the text), said (lines 2 to 4), rest (further lines), buyer, seller, class_, edges."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    d = read("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    edge = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"), F.lit("/"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("parent"), day("l_shipdate").alias("date"))
    edges = read("lineitem").join(d.select("doc_id"), F.col("l_orderkey") == F.col("doc_id")).groupBy("doc_id").agg(F.array_sort(F.collect_list(edge)).alias("edges"))  # an order's few lines
    known = d.select("doc_id").distinct()
    o = read("orders").select(F.col("o_orderkey").alias("doc_id"), day("o_orderdate").alias("filed"), "o_custkey").join(known, "doc_id", "left_semi")
    o = o.join(read("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("buyer")), "o_custkey", "left").drop("o_custkey")
    head = F.get("edges", F.lit(0))
    edges = edges.withColumn("p_partkey", head["l_partkey"]).withColumn("s_suppkey", head["l_suppkey"])
    edges = edges.join(read("part").select("p_partkey", F.concat("p_brand", F.lit("  "), "p_type").alias("class_")), "p_partkey", "left").join(read("supplier").select("s_suppkey", F.col("s_name").alias("seller")), "s_suppkey", "left")
    # all but the texts is joined first, so that these are moved once, by doc_id
    d = d.join(o, "doc_id", "left").join(edges.drop("p_partkey", "s_suppkey"), "doc_id", "left").withColumn("lines", lines).withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,parent:string,date:string>>")))
    turn = F.floor(F.col("doc_id") / 6)
    kind = F.element_at(F.array(*map(F.lit, ("B1", "B2", "E1", "S1"))), (turn % 4 + 1).cast("int"))
    return d.select(
        "doc_id", (F.col("doc_id") % 6).alias("family"), turn.alias("turn"), F.lpad((F.col("doc_id") + 1000000).cast("string"), 8, "0").alias("number"), F.when((F.col("doc_id") % 6).isin(1, 3), "A1").otherwise(kind).alias("kind"),
        F.coalesce("filed", F.lit("")).alias("filed"), F.concat(F.lit("Item "), "source", F.lit(" & <"), "lang", F.lit(">")).alias("title"), F.coalesce(F.get("lines", F.lit(0)), F.lit("")).alias("first"),
        F.slice("lines", 2, 3).alias("said"), F.slice("lines", 5, F.size("lines")).alias("rest"), F.coalesce("buyer", F.lit("")).alias("buyer"), F.coalesce("seller", F.lit("")).alias("seller"), F.coalesce("class_", F.lit("")).alias("class_"), "edges",
    )


def _each(items: Column, one) -> Column:
    return F.array_join(F.transform(items, one), "")


def _put(template: str, **values: Column) -> Column:
    """The template with columns in place of {name}."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def _modern(kind: str, version: Column) -> Column:
    root = f"us-patent-{kind}"
    ids = "<document-id><country>US</country><doc-number>{number}</doc-number><kind>{kind}</kind><date>{filed}</date></document-id>"
    person = "<inventor><addressbook><last-name>{buyer}</last-name><first-name>%s</first-name></addressbook></inventor>"
    edge = lambda e, i: (
        F.when(i == 0, _put("<us-provisional-application><document-id><doc-number>{n}</doc-number><date>{d}</date></document-id></us-provisional-application>", n=e["parent"], d=e["date"]))
        .otherwise(_put("<{tag}><relation><parent-doc><document-id><doc-number>{n}</doc-number><date>{d}</date></document-id></parent-doc><child-doc><document-id><doc-number>{own}</doc-number></document-id></child-doc></relation></{tag}>", tag=F.when(i == 1, "continuation").otherwise("division"), n=e["parent"], d=e["date"], own=F.col("number")))
    )
    para = lambda x, i: _put('<p id="p-{n}" num="{n}">{x}</p>', n=F.lpad((i + 1).cast("string"), 4, "0"), x=escaped(x))
    rest = F.transform("rest", para)
    said = lambda x, i: F.when(i == 0, _put('<claim id="CLM-1"><claim-text>1. {x}<claim-text>wherein  it turns.</claim-text></claim-text></claim>', x=escaped(x))).otherwise(_put('<claim><claim-text>The <b>thing</b> of <claim-ref idref="CLM-1">claim 1</claim-ref>, {x}</claim-text></claim>', x=escaped(x)))
    body = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE ' + root + ' SYSTEM "' + root + '-v4{v}.dtd" [ ]>\n<' + root + ' lang="EN" dtd-version="{mark}" file="US{number}-X.XML">\n<us-bibliographic-data-' + kind + "><publication-reference>" + ids + "</publication-reference>"
        '<application-reference appl-type="utility"><document-id><doc-number>{number}</doc-number><date>{filed}</date></document-id></application-reference><us-application-series-code>01</us-application-series-code>'
        "<classifications-ipcr><classification-ipcr><section>A</section><class>01</class><subclass>B</subclass><main-group>{turn}</main-group><subgroup>02</subgroup></classification-ipcr><classification-ipcr><section>A</section></classification-ipcr></classifications-ipcr>"
        "<classification-national><country>US</country><main-classification>{class}</main-classification><further-classification>2423</further-classification><further-classification>{class}</further-classification></classification-national>"
        "<invention-title>{title}</invention-title><us-related-documents>{edges}<reissue><document-id/></reissue></us-related-documents><us-parties><us-applicants><us-applicant><addressbook><orgname>{buyer}</orgname></addressbook></us-applicant></us-applicants>"
        "<inventors>" + person % "Ann" + person % "Bo" + person % "Ann" + "</inventors></us-parties><assignees><assignee><addressbook><first-name>Cy</first-name><middle-name>D.</middle-name><last-name>{seller}</last-name></addressbook></assignee></assignees></us-bibliographic-data-" + kind + ">"
        '<abstract><p num="0000">{first}</p><p>' + MADE_OF + "</p></abstract>"
        '<drawings><figure id="F1" num="00001"><img id="I1" file="{number}-D1.TIF"/></figure></drawings>'
        '<description><?BRFSUM description="Brief Summary" end="lead"?><heading level="1">BACKGROUND</heading>{brief}<?BRFSUM description="Brief Summary" end="tail"?><?DETDESC description="Detailed" end="lead"?>{long}<table a="1"><row/></table></description>'
        "<claims>{claims}<claim> </claim></claims></" + root + ">"
    )
    return _put(
        body, v=version, mark=F.concat(F.lit("v4"), F.when(version == "0", "").otherwise(".") if kind == "grant" else F.lit("."), version), number=F.col("number"), kind=F.col("kind"), filed=F.col("filed"),
        turn=F.col("turn").cast("string"), title=escaped(F.col("title")), edges=_each(F.col("edges"), edge), buyer=F.col("buyer"), seller=F.col("seller"), first=escaped(F.col("first")),
        brief=F.array_join(F.slice(rest, 1, 2), ""), long=F.array_join(F.slice(rest, 3, F.greatest(F.size("rest"), F.lit(1))), ""), claims=_each(F.col("said"), said), **{"class": F.col("class_")},
    )


def _grant25() -> Column:
    d = lambda x: f"<PDAT>{x}</PDAT>"
    edge = lambda e, i: (
        F.when(i == 0, _put(f"<B680US><DOC><DNUM>{d('{n}')}</DNUM><DATE>{d('{d}')}</DATE></DOC></B680US>", n=e["parent"], d=e["date"]))
        .otherwise(_put(f"<B620><PARENT-US><CDOC><DOC><DNUM>{d('{own}')}</DNUM></DOC></CDOC><PDOC><DOC><DNUM>{d('{n}')}</DNUM><DATE>{d('{d}')}</DATE></DOC></PDOC></PARENT-US></B620>", own=F.col("number"), n=e["parent"], d=e["date"]))
    )
    para = lambda x, i: _put(f'<PARA ID="P-1" LVL="0"><PTEXT>{d("{x}")}</PTEXT></PARA>', x=escaped(x))
    rest = F.transform("rest", para)
    said = lambda x, i: _put(f'<CLM ID="CLM-1"><PARA ID="P-2"><PTEXT>{d("{x}")}<BOLD>{d("bold")}</BOLD></PTEXT></PARA><CLMSTEP LVL="2"><PTEXT>{d("a step.")}</PTEXT></CLMSTEP></CLM>', x=escaped(x))
    body = (
        f'<?xml version="1.0"?>\n<!DOCTYPE PATDOC SYSTEM "ST32-US-Grant-025xml.dtd">\n<PATDOC DTD="2.5"><SDOBI><B100><B110><DNUM>{d("{number}")}</DNUM></B110><B130>{d("{kind}")}</B130><B140><DATE>{d("{filed}")}</DATE></B140><B190>{d("US")}</B190></B100>'
        f"<B200><B210><DNUM>{d('{number}')}</DNUM></B210><B220><DATE>{d('{filed}')}</DATE></B220></B200><B500><B510><B511>{d('A01B  1/02')}</B511></B510><B520><B521>{d('{class}')}</B521><B522>{d('2423')}</B522></B520><B540><STEXT>{d('{title}')}</STEXT></B540></B500>"
        f"<B600>{{edges}}</B600><B700><B720><B721><PARTY-US><NAM><FNM>{d('Ann')}</FNM><SNM><STEXT>{d('{buyer}')}</STEXT></SNM></NAM></PARTY-US></B721></B720><B730><B731><PARTY-US><NAM><ONM><STEXT>{d('{seller}')}</STEXT></ONM></NAM></PARTY-US></B731></B730></B700></SDOBI>"
        f'<SDOAB><BTEXT><PARA ID="P-0"><PTEXT>{d("{first}")}</PTEXT></PARA><PARA><PTEXT>{d("Made of ")}<BOLD>{d("steel")}</BOLD><ITALIC>{d("!")}</ITALIC></PTEXT></PARA></BTEXT></SDOAB>'
        f'<SDODE><BRFSUM><BTEXT><H LVL="1"><STEXT>{d("BACKGROUND")}</STEXT></H>{{brief}}</BTEXT></BRFSUM><DETDESC><BTEXT>{{long}}<CWU><X/></CWU></BTEXT></DETDESC></SDODE><SDOCL><H LVL="1"><STEXT>{d("What is claimed is:")}</STEXT></H><CL>{{claims}}</CL></SDOCL><SDODR ID="D"><EMI ID="E1" FILE="{{number}}-D1.TIF"/></SDODR></PATDOC>'
    )
    return _put(body, number=F.col("number"), kind=F.col("kind"), filed=F.col("filed"), title=escaped(F.col("title")), edges=_each(F.col("edges"), edge), buyer=F.col("buyer"), seller=F.col("seller"), first=escaped(F.col("first")), brief=F.array_join(F.slice(rest, 1, 2), ""), long=F.array_join(F.slice(rest, 3, F.greatest(F.size("rest"), F.lit(1))), ""), claims=_each(F.col("said"), said), **{"class": F.col("class_")})


def _application15(version: Column) -> Column:
    edge = lambda e, i: _put("<{tag}><document-id><doc-number>{n}</doc-number><document-date>{d}</document-date></document-id></{tag}>", tag=F.when(i == 0, "continuation-of").when(i == 1, "continuations").otherwise("division-of"), n=e["parent"], d=e["date"])
    para = lambda x, i: _put('<paragraph id="P-1" lvl="0"><number>&lsqb;{n}&rsqb;</number> {x}</paragraph>', n=F.lpad((i + 1).cast("string"), 4, "0"), x=escaped(x))
    rest = F.transform("rest", para)
    said = lambda x, i: _put('<claim id="C-1"><claim-text>1. {x}<claim-text>wherein <dependent-claim-reference depends_on="C-1"><claim-text>claim 1</claim-text></dependent-claim-reference> turns.</claim-text></claim-text></claim>', x=escaped(x))
    body = (
        '<?xml version="1.0"?>\n<!DOCTYPE patent-application-publication SYSTEM "{dtd}" []>\n<patent-application-publication><subdoc-bibliographic-information><document-id><doc-number>{number}</doc-number><kind-code>{kind}</kind-code><document-date>{filed}</document-date><country-code>US</country-code></document-id>'
        '<publication-filing-type>new</publication-filing-type><domestic-filing-data><application-number appl-type="utility"><doc-number>{serial}</doc-number></application-number><application-number-series-code>10</application-number-series-code><filing-date>{filed}</filing-date></domestic-filing-data>'
        "<technical-information><classification-ipc><classification-ipc-primary><ipc>A01B {turn}</ipc></classification-ipc-primary><classification-ipc-secondary><ipc>Z</ipc></classification-ipc-secondary></classification-ipc><classification-us><classification-us-primary><uspc><class>{class}</class><subclass>9</subclass></uspc></classification-us-primary></classification-us><title-of-invention>{title}</title-of-invention></technical-information>"
        "<continuity-data>{edges}</continuity-data><inventors><first-named-inventor><name><given-name>Ann</given-name><family-name>{buyer}</family-name></name></first-named-inventor><inventor><name><given-name>Bo</given-name></name></inventor><inventor><name><given-name>Ann</given-name><family-name>{buyer}</family-name></name></inventor></inventors>"
        "<assignee><organization-name>{seller} &lt;Inc&gt;</organization-name></assignee><correspondence-address><name-1>N</name-1><address><address-1>A</address-1><city>C</city></address></correspondence-address></subdoc-bibliographic-information>"
        '<subdoc-abstract><paragraph id="A-1">{first}</paragraph><paragraph>Made of <bold>steel</bold> and <italic>H<subscript>2</subscript>O</italic>.</paragraph></subdoc-abstract>'
        '<subdoc-description><cross-reference-to-related-applications><heading lvl="1">CROSS</heading><paragraph>See others.</paragraph></cross-reference-to-related-applications><summary-of-invention><section><heading lvl="1">BACKGROUND</heading>{brief}</section><paragraph>loose</paragraph></summary-of-invention><detailed-description><section>{long}</section></detailed-description></subdoc-description>'
        '<subdoc-claims><heading lvl="1">We claim</heading>{claims}</subdoc-claims><subdoc-drawings><heading>Figs</heading><representative-figure>1</representative-figure><figure id="F1"><image id="I1" file="{number}-D1.TIF"/></figure></subdoc-drawings></patent-application-publication>'
    )
    return _put(body, dtd=version, number=F.col("number"), serial=F.substr("number", F.lit(3), F.lit(6)), kind=F.col("kind"), filed=F.col("filed"), turn=F.col("turn").cast("string"), title=escaped(F.col("title")), edges=_each(F.col("edges"), edge), buyer=F.col("buyer"), seller=F.col("seller"), first=escaped(F.col("first")), brief=F.array_join(F.slice(rest, 1, 2), ""), long=F.array_join(F.slice(rest, 3, F.greatest(F.size("rest"), F.lit(1))), ""), claims=_each(F.col("said"), said), **{"class": F.col("class_")})


def _tagged() -> Column:
    turn = F.col("turn") % 4
    said = lambda x, i: _put("NUM  {n}.\nPAR  {n}. {x}\n     and more\nPA1  a step.\n", n=(i + 1).cast("string"), x=x)
    body = (
        "HHHHHT APS1 ISSUE\nPATN\nWKU  {wku}\nSRC  6\nAPN  {apn}\nAPT  1\nTTL  {title}\nISD  {filed}\nAPD  {filed}\nINVT\nNAM  {buyer}; Ann\nCTY  Town\nINVT\nNAM  Bo\nASSG\nNAM  {seller}\nCOD  02\nCLAS\nOCL  {class}\nXCL    2423\nICL  A42B  300\nICL  A42B 124\n"
        "ABST\nPAL  {first}\n     goes on.\nBSUM\nPAC  BACKGROUND\n{brief}DRWD\nDETD\n{long}TBL  1   2\n     ---\n     3   4\nCLMS\nSTM  What is claimed is:\n{claims}"
    )
    para = F.transform("rest", lambda x: F.concat(F.lit("PAR  "), x, F.lit("\n")))
    number = F.substr("number", F.lit(2))
    key = F.when(turn == 0, F.concat(F.lit("0"), number, F.lit("1"))).when(turn == 1, F.concat(F.lit("D"), number, F.lit("&"))).when(turn == 2, F.concat(F.lit("RE"), number, F.lit("3"))).otherwise(F.concat(F.lit("PP"), number, F.lit("4")))
    return _put(body, wku=key, apn=F.concat("number", F.when(turn < 2, "&").otherwise("")), title=F.col("title"), filed=F.col("filed"), buyer=F.col("buyer"), seller=F.col("seller"), first=F.col("first"), brief=F.array_join(F.slice(para, 1, 2), ""), long=F.array_join(F.slice(para, 3, F.greatest(F.size("rest"), F.lit(1))), ""), claims=_each(F.col("said"), said), **{"class": F.col("class_")})


#: Where the records of a session's tables are, once they are made.
_MADE: dict[tuple[str, str], str] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of made_corpus(), which are written once a session and folder of tables: all queries read the same ones."""
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _MADE.get(key)
    if path is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = path if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None
    made = made_corpus(spark, sf_dir)
    if path is None:
        path = scratch(spark, "corpus")
        made.write.parquet(path)
        _MADE[key] = path
    return spark.read.schema(made.schema).parquet(path)


def made_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw record for each document: doc_id, shard, raw. By doc_id mod 6: a grant of version 4.0 to 4.7, an application of
    4.0 to 4.6, a grant of 2.5, an application of 1.5 or 1.6, tagged text (utility, design, reissue, plant), and in turn
    two supplemental roots, an unknown root, conflicting markers, and broken XML."""
    d = facts(spark, sf_dir)
    nth = lambda n: (F.col("turn") % n).cast("string")
    k = F.col("turn") % 5
    bad = (
        F.when(k == 0, '<?xml version="1.0"?><sequence-cwu/>').when(k == 1, '<?xml version="1.0"?><!-- t --><table a="1"/>').when(k == 2, '<?xml version="1.0"?><other/>')
        .when(k == 3, '<!DOCTYPE us-patent-application><us-patent-grant dtd-version="v4.5"/>').otherwise('<us-patent-grant dtd-version="v4.5"><a></us-patent-grant>')
    )
    dtd = F.when(F.col("turn") % 2 == 0, "pap-v15-2001-01-31.dtd").otherwise("pap-v16-2002-01-01.dtd")
    m = F.col("family")
    raw = F.when(m == 0, _modern("grant", nth(8))).when(m == 1, _modern("application", nth(7))).when(m == 2, _grant25()).when(m == 3, _application15(dtd)).when(m == 4, _tagged()).otherwise(bad)
    return d.select("doc_id", F.concat(F.lit("ipg"), (F.col("doc_id") % 8).cast("string")).alias("shard"), raw.alias("raw"))
