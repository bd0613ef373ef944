"""Table schemas of the data model, and the column names of the exchanged CSV files."""
from __future__ import annotations

from pyspark.sql import types as T

S, L, I = T.StringType(), T.LongType(), T.IntegerType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENT = struct(id=S, text=S, metadata=T.MapType(S, S))
CHUNK = struct(id=S, text=S, chunk_id=I, metadata=T.MapType(S, S))
RECORD = struct(file_name=S, line_no=L, id=S, original_text=S, entity_relation_dict=S, event_entity_relation_dict=S, event_relation_dict=S)
CONCEPTUALIZED = struct(node=S, conceptualized_node=S, node_type=S)
CONCEPT = struct(name=S, type=S, abstraction_level=S, description=S, source_chunk=S)
RELATIONSHIP = struct(source=S, target=S, relation=S, description=S, source_chunk=S)
TRIPLE_TSV = struct(h=S, r=S, t=S)
TYPE_TSV = struct(entity=S, type=S)
QA_HOTPOT = T.StructType([
    T.StructField("_id", S), T.StructField("question", S), T.StructField("answer", S),
    T.StructField("supporting_facts", T.ArrayType(T.ArrayType(S))), T.StructField("context", S)])
QA_MUSIQUE = T.StructType([
    T.StructField("question", S), T.StructField("answer", S),
    T.StructField("paragraphs", T.ArrayType(struct(paragraph_text=S, is_supporting=T.BooleanType())))])
FACTUALITY = T.StructType([
    T.StructField("index", S), T.StructField("prompt", S), T.StructField("response", S), T.StructField("ref", T.ArrayType(S)),
    T.StructField("segmented_response", T.ArrayType(S)), T.StructField("labels", T.ArrayType(T.BooleanType())),
    T.StructField("domain", S), T.StructField("type", S), T.StructField("comment", T.ArrayType(S))])

# Headers of the exchanged CSV tables, in file order.
NODE_HEADER = {"name": "name:ID", "type": "type", "concepts": "concepts", "synsets": "synsets", "label": ":LABEL"}
EDGE_HEADER = {"start_id": ":START_ID", "end_id": ":END_ID", "relation": "relation", "concepts": "concepts", "synsets": "synsets", "type": ":TYPE"}
TEXT_NODE_HEADER = {"text_id": "text_id:ID", "original_text": "original_text", "label": ":LABEL"}
TEXT_EDGE_HEADER = {"start_id": ":START_ID", "end_id": ":END_ID", "type": ":TYPE"}
CONCEPT_NODE_HEADER = {"concept_id": "concept_id:ID", "name": "name", "label": ":LABEL"}
CONCEPT_EDGE_HEADER = {"start_id": ":START_ID", "end_id": ":END_ID", "relation": "relation", "type": ":TYPE"}
WORKLIST_HEADER = {"Name": "Name", "Type": "Type"}
