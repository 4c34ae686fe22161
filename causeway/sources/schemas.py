"""Schemas of files that are read; every reader states its own, and none is inferred."""

INDICATOR = "country string, county string, state string, source string, unit string, variable string, year int, month int, value double"

_SIDE = "struct<concept:string,concept_score:double,polarity:int,adjectives:array<string>,theme:string>"
_CONTEXT = "struct<subj_adjectives:array<string>,subj_polarity:int,obj_adjectives:array<string>,obj_polarity:int,text:string>"
STATEMENT = f"struct<id:string,belief:double,subj:{_SIDE},obj:{_SIDE},evidence:array<struct<evidence_context:{_CONTEXT}>>>"
_SERIES = "struct<name:string,source:string,func:string,minValue:double,maxValue:double,numLevels:int,period:int,resolution:string,values:array<struct<timestamp:bigint,value:double>>>"
MODEL = f"id string, statements array<{STATEMENT}>, conceptIndicators map<string,{_SERIES}>"

PARAM = "startTime bigint, endTime bigint, constraints array<struct<concept:string,values:array<struct<step:int,value:double>>>>"

_AGENT = "struct<concept:struct<name:string,db_refs:map<string,string>>,delta:struct<polarity:int,adjectives:array<string>>>"
_NOTES = "struct<subj_polarity:int,obj_polarity:int,subj_adjectives:array<string>,obj_adjectives:array<string>>"
EXTRACTED = f"type string, belief double, id string, subj {_AGENT}, obj {_AGENT}, evidence array<struct<source_api:string,text:string,annotations:{_NOTES}>>"

TIMING = "run int, nodes int, edges int, kernels int, wall_ns bigint, cpu_ns bigint, kind int"
_END = "struct<type:string,source:string,content:string,content_type:string>"
LINKS = f"grounding array<struct<element_1:{_END},element_2:{_END},score:double>>"
EDITS = "relations array<struct<source:string,target:string,polarity:int,weights:array<double>>>"
