"""Workers keep large tables only while tasks use them, and functions are sent without them."""

import public_tokenizers
import pyarrow as pa
from pyspark import cloudpickle

from spendloom.llm import bpe, op10_packing, textblock


def _batches():
    return iter([pa.RecordBatch.from_pydict({"text": ["a b c"]})])


def test_tables_go_when_a_task_of_another_kind_begins():
    bpe.load(public_tokenizers.path(op10_packing.VOCABULARY))
    assert [*textblock.tidy(keeps=True)(lambda batches: batches)(_batches())]
    assert bpe.load.cache_info().currsize == 1
    assert [*textblock.tidy(lambda batches: batches)(_batches())]
    assert bpe.load.cache_info().currsize == 0


def test_functions_are_sent_without_tables_and_powers_of_long_texts_go():
    bpe.load(public_tokenizers.path(op10_packing.VOCABULARY))
    textblock.powers(4 * textblock.BLOCK_BYTES)
    wrapped = textblock.tidy(lambda batches: batches)
    assert len(cloudpickle.dumps(wrapped)) < 10_000
    assert [*wrapped(_batches())]
    assert len(textblock._powers[0]) == 1
