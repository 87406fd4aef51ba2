"""Small workbook files as raw XML."""

import io
import zipfile

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*items):
    body = "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{p}"/>' for i, t, p in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def workbook(**more):
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN}><workbookPr date1904="1"/><sheets><sheet name="Sales" sheetId="1" r:id="rId1"/><sheet name="Hidden" sheetId="2" state="hidden" r:id="rId2"/></sheets>'
        "<definedNames><definedName name=\"Total\">Sales!$B$5</definedName><definedName name=\"Ext\">[rates.xlsx]Daily!$A$1</definedName></definedNames></workbook>",
        "xl/_rels/workbook.xml.rels": rels(("rId1", "worksheet", "worksheets/sheet1.xml"), ("rId2", "worksheet", "/xl/worksheets/sheet2.xml")),
        "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>Item</t></si><si><r><t>Pri</t></r><r><t>ce</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="$#,##0.00"/></numFmts><fonts><font><sz val="11"/></font><font><b/><sz val="14"/></font></fonts>'
        '<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFC7CE"/></patternFill></fill></fills>'
        '<cellXfs><xf numFmtId="0" fontId="0" fillId="0"/><xf numFmtId="164" fontId="1" fillId="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {MAIN}><sheetFormatPr defaultRowHeight="15"/><cols><col min="2" max="2" width="20" hidden="1"/></cols><sheetData>'
        '<row r="1" ht="30"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1" t="s" s="1"><v>1</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>Widget</t></is></c><c r="B2"><v>5</v></c></row>'
        '<row r="3" hidden="1"><c r="A3" t="b"><v>1</v></c><c r="B3"><v>2.5</v></c></row><row r="4"><c r="A4" t="e"><v>#REF!</v></c></row><row r="5"><c r="A5" t="str"><f>A2</f><v>Widget</v></c><c r="B5" s="1"><f>SUM(B2:B3)</f><v>7.5</v></c></row>'
        '</sheetData><autoFilter ref="A1:B5"/><mergeCells><mergeCell ref="A7:B8"/></mergeCells><conditionalFormatting sqref="B2:B3"><cfRule type="cellIs" operator="greaterThan" priority="1"><formula>3</formula></cfRule></conditionalFormatting>'
        '<dataValidations><dataValidation type="list" sqref="A2" allowBlank="1"><formula1>"a,b"</formula1></dataValidation></dataValidations><hyperlinks><hyperlink ref="A2" r:id="rId9"/></hyperlinks></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": rels(("rId1", "table", "../tables/table1.xml"), ("rId2", "drawing", "../drawings/drawing1.xml"), ("rId3", "comments", "../comments1.xml")).replace(
            "</Relationships>", f'<Relationship Id="rId9" Type="{REL}/hyperlink" Target="https://example.com" TargetMode="External"/></Relationships>'
        ),
        "xl/tables/table1.xml": f'<table {MAIN} displayName="SalesData" ref="A1:B3"><tableColumns><tableColumn id="1" name="Item"/><tableColumn id="2" name="Price"/></tableColumns></table>',
        "xl/comments1.xml": f'<comments {MAIN}><commentList><comment ref="B2"><text><t>check</t></text></comment></commentList></comments>',
        "xl/drawings/drawing1.xml": f'<wsDr xmlns:r="{REL}"><twoCellAnchor><from><col>3</col><row>1</row></from><to><col>9</col><row>12</row></to><graphicFrame><chart r:id="rId1"/></graphicFrame></twoCellAnchor></wsDr>',
        "xl/drawings/_rels/drawing1.xml.rels": rels(("rId1", "chart", "../charts/chart1.xml")),
        "xl/charts/chart1.xml": "<chartSpace><chart><title><tx><rich><p><r><t>Prices</t></r></p></rich></tx></title><plotArea><barChart><ser><tx><v>Price</v></tx><cat><strRef><f>Sales!A2:A3</f></strRef></cat><val><numRef><f>Sales!$B$2:$B$3</f></numRef></val></ser></barChart><catAx/><valAx/></plotArea></chart></chartSpace>",
        "xl/worksheets/sheet2.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="XFD1"><v>1</v></c></row><row r="1048576"><c r="A1048576"><v>2</v></c></row></sheetData></worksheet>',
    } | more
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
