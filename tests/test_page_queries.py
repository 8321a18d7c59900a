"""Pages made of whole tables: items are numbered once, whatever is made of them."""

from plumbline.plans import q_pages

SF = "/root/testdata/sf0.001"


def numbered(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().count("row_number()")


def test_items_are_numbered_once(spark):
    assert numbered(q_pages._statements(spark, SF)) == 1
    lines, pages = q_pages._report(spark, SF)
    assert numbered(lines) == 1 and numbered(pages) == 1
    assert lines.where("text like 'Supplier %'").count() == pages.count() == pages.distinct().count()
