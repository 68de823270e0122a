from arborlens.llm.evidence import GENERATED, MINIFIED, VENDORED, file_evidence

CODE = "import { load } from './load';\n\nexport function add(a, b) {\n  if (a) {\n    return a + b;\n  }\n}\n"
NOTICE = "// Code generated by tool. DO NOT EDIT.\n"


def evidence(text):
    return file_evidence("a.ts", text.encode())


def test_notice_below_a_long_header():
    plain = evidence("// terms and conditions\n" * 60 + CODE)
    assert evidence("// terms and conditions\n" * 60 + NOTICE + CODE)[GENERATED] > plain[GENERATED]


def test_notice_in_a_very_long_line():
    banner = "// " + "=" * 500
    assert evidence(banner + " DO NOT EDIT\n" + CODE)[GENERATED] > evidence(banner + "\n" + CODE)[GENERATED]
    licence = "/*! lib v1.2.3 | (c) Other People | MIT license " + "." * 500 + " */\n"
    assert evidence(licence + CODE)[VENDORED] > evidence("/* " + "." * 500 + " */\n" + CODE)[VENDORED]


def test_code_of_long_lines_is_no_comment():
    code = "var a=n.build(1);function c(d,e){return d.f?e(c):'do not edit'};" * 20
    for lead in ("", ";", "/* x */"):
        found = evidence(lead + code)
        assert found[MINIFIED] == max(found)
