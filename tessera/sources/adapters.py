"""Models and readers that live outside Spark: an interface for them, and the rules on what they say.

None of the libraries is needed to import this; asking for one that isn't installed is a clear error.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import schema
from tessera.errors import DetectorUnavailable
from tessera.functions import fuzzy, spans

RAW = "array<struct<label:string,start:int,end:int,score:double>>"
# What a general recogniser's labels mean here.
LABELS = {"PERSON": "person", "ORGANIZATION": "company", "EMAIL_ADDRESS": "email", "PHONE_NUMBER": "phone", "CREDIT_CARD": "credit_card", "US_SSN": "ssn", "IP_ADDRESS": "ip_address", "LOCATION": "address", "DATE_TIME": "dob"}
NER_LABELS, NER_SCORES = {"PERSON": "person", "ORG": "company"}, {"PERSON": 0.85, "ORG": 0.80}


def require(module: str):
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise DetectorUnavailable(f"{module} is not installed; install it on every worker to use this detector") from e


def pieces(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """A text's pieces with their places, for models that can't take a whole one; the rule of ``detect.chunks``."""
    start = 0
    while True:
        end = min(start + size, len(text))
        if end < len(text):
            end = next((at for mark in ("\n\n", "\n") if (at := text.rfind(mark, start, end)) > start), end)
        yield start, text[start:end]
        if end >= len(text):
            return
        start = max(start + 1, end - overlap)


def with_raw(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[list[tuple]]]], column: str = "raw", text: str = "text", size: int = 40_000, overlap: int = 1_000) -> DataFrame:
    """``docs`` with what a model says of each text; ``make`` runs once in a worker and returns the model.

    The model takes a list of texts and gives for each a list of ``(label, start, end, score)``. Blank and
    null texts aren't shown to it. It sees long texts in pieces of ``size`` characters that overlap;
    places are moved to those in the whole text, and what two pieces both hold is told once.
    """

    @F.pandas_udf(RAW)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            shown = [(row, at, piece) for row, t in enumerate(texts) if t and t.strip() for at, piece in pieces(t, size, overlap)]
            found: list[dict[tuple, None]] = [{} for _ in texts]
            for (row, at, _), said in zip(shown, model([piece for *_, piece in shown]) if shown else [], strict=True):
                found[row].update(dict.fromkeys((label, start + at, end + at, score) for label, start, end, score in said))
            yield pd.Series([[dict(zip(("label", "start", "end", "score"), x, strict=True)) for x in rows] for rows in found])

    return docs.withColumn(column, run(text))


def general_entities(text: Column, raw: Column, source: str = "presidio_detector") -> Column:
    """Entities from a general recogniser's finds.

    A date counts only near words of birth and then with 0.75 at least; a company's confidence is shaped
    by its name; a place alone gets 0.6 at most. Other labels are ignored.
    """
    known = F.filter(raw, lambda r: r["label"].isin(*LABELS))

    def entity(r: Column) -> Column:
        kind = F.element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), r["label"])
        value = spans.piece(text, r["start"], r["end"])
        company = fuzzy.company_confidence(value, r["score"], spans.preceding_word(text, r["start"]))
        score = F.when(kind == "dob", F.greatest(r["score"], F.lit(0.75))).when(kind == "company", company).when(kind == "address", F.least(r["score"], F.lit(0.6))).otherwise(r["score"])
        return _struct(kind, r, value, score, source)

    born = F.filter(known, lambda r: (r["label"] != "DATE_TIME") | fuzzy.birth_context(spans.context_window(text, r["start"], r["end"])))
    return F.transform(born, entity)


def ner_entities(text: Column, raw: Column, source: str = "spacy_ner") -> Column:
    """Persons and companies from a named-entity model, with fixed scores."""
    known = F.filter(raw, lambda r: r["label"].isin(*NER_LABELS))

    def entity(r: Column) -> Column:
        value = spans.piece(text, r["start"], r["end"])
        person = r["label"] == "PERSON"
        score = F.when(person, F.lit(NER_SCORES["PERSON"])).otherwise(fuzzy.company_confidence(value, F.lit(NER_SCORES["ORG"]), spans.preceding_word(text, r["start"])))
        return _struct(F.when(person, "person").otherwise("company"), r, value, score, source)

    return F.transform(known, entity)


def _struct(kind: Column, r: Column, value: Column, score: Column, source: str) -> Column:
    return F.struct(kind.alias("type"), r["start"].alias("start"), r["end"].alias("end"), value.alias("text"), score.alias("confidence"), F.lit(source).alias("source"), F.lit(0).alias("ordinal"))


def spacy_model(name: str = "en_core_web_md") -> Callable[[list[str]], list[list[tuple]]]:
    nlp = require("spacy").load(name)
    return lambda texts: [[(e.label_, e.start_char, e.end_char, 1.0) for e in doc.ents] for doc in nlp.pipe(texts)]


def ocr_rows(images: DataFrame) -> DataFrame:
    """Words of images (``image_id, content``) as ``blocks.ocr_words`` takes them; needs Tesseract."""
    columns = ("image_id", "i", "text", "conf", "block", "par", "line", "left", "top", "width", "height")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        tesseract, image = require("pytesseract"), require("PIL.Image")
        for batch in batches:
            rows = []
            for name, content in zip(batch["image_id"], batch["content"], strict=True):
                d = tesseract.image_to_data(image.open(io.BytesIO(content)), output_type=tesseract.Output.DICT)
                rows += [(name, i, d["text"][i], str(d["conf"][i]), *(d[k][i] for k in ("block_num", "par_num", "line_num", "left", "top", "width", "height"))) for i in range(len(d["text"]))]
            yield pd.DataFrame(rows, columns=columns)

    return images.select("image_id", "content").mapInPandas(run, "image_id string, i int, text string, conf string, block int, par int, line int, left int, top int, width int, height int")


def pdf_rows(files: DataFrame) -> DataFrame:
    """Words of PDF files (``path, content``) as ``blocks.pdf_words`` takes them; needs PyMuPDF."""
    columns = ["doc_id", "page", "block", "line", "word", "text", "bbox"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitz = require("fitz")
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for n, page in enumerate(fitz.open(stream=content, filetype="pdf")):
                    rows += [(path, n, w[5], w[6], w[7], w[4], list(w[:4])) for w in page.get_text("words")]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, "doc_id string, page int, block int, line int, word int, text string, bbox array<double>")
