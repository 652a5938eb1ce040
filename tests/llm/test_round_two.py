"""Added tokens of the tokenizer, verdicts of rows without language."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from notewright.llm import chat_format, packing, quality_rules, word_bpe


def test_added_tokens_are_the_librarys():
    path = public_tokenizers.path(packing.TOKENIZER)
    library = Tokenizer.from_file(path)
    texts = ["<|endoftext|> begin", "in <|endoftext|> between", "end <|startoftext|>", "with<|endoftext|>in", "<|endoftext|><|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "é<|startoftext|>é z", "plain"]
    cache = word_bpe.WordCache(word_bpe.WordBpe(path))
    assert [x.tolist() for x in cache.encode([t.encode() for t in texts])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_filter_and_query_agree_on_null_languages(spark, monkeypatch):
    """A cutoff of the language "" is no cutoff of rows without one."""
    monkeypatch.setattr(quality_rules, "fit_cutoffs", lambda *a: {("", "symbols"): 0.0, ("en", "symbols"): 0.0})
    text = " ".join(f"w{i}" for i in range(80)) + " $"
    docs = spark.createDataFrame([(1, text, None), (2, text, ""), (3, text, "en"), (4, text, "fr"), (5, None, "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    kept = sorted(r.doc_id for r in quality_rules.quality_rules(docs, labels).where("kept").collect())
    assert kept == sorted(r.doc_id for r in quality_rules.keep_good(docs, labels).collect()) == [1, 4]


def test_a_template_sees_the_whole_conversation(spark):
    source = "{% for m in messages %}{% if loop.first %}A{% endif %}{{ loop.index0 }}{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}Z"
    rows = spark.createDataFrame([(1, 1, "user", "p"), (1, 2, "x", "qq"), (2, 1, "user", None), (None, 1, "a", "n")], "conv_id long, turn long, role string, text string")
    by = {}
    for r in sorted(chat_format.format_conversations(rows, source).collect(), key=lambda r: (str(r.conv_id), r.part)):
        text, spans = by.setdefault(r.conv_id, ["", []])
        by[r.conv_id][0] += r.text
        spans += [(s.start, s.end) for s in r.loss_spans]
    assert by == {1: ["A0p1qqZ", [(2, 3), (4, 6)]], 2: ["A0Z", []], None: ["A0nZ", [(2, 3)]]}


def test_wrong_types_are_the_templates_errors():
    for source in ("{{ 'a' + 1 }}", "{{ 1 | upper }}"):
        with pytest.raises(chat_format.TemplateError):
            chat_format.Template(source)
    with pytest.raises(chat_format.TemplateError):
        chat_format.Template("{{ x + 1 }}").render([], x="a")
    assert chat_format.Template("{{ x | length }}{{ x | upper }}").render([])[0] == "0"
