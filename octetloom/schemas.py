"""Types that decoders return."""

from __future__ import annotations

PATH = "array<struct<name:string,kind:string,offset:bigint,size:bigint>>"
ERROR = f"struct<code:string,component:string,offset:decimal(20,0),length:decimal(20,0),stream_length:decimal(20,0),path:{PATH}>"
LZ_HEADER = "struct<decompressed_size:bigint,alignment:bigint,unused:bigint>"
LZ_OPS = "block_idx bigint, op_idx int, kind string, byte smallint, offset int, length int, out_start bigint"
TREE_HEADER = "struct<endian:string,version:int,key_table_offset:bigint,string_table_offset:bigint,binary_data_table_offset:bigint,root_data_offset:bigint>"
STRING_ROWS = "idx int, offset bigint, raw binary, value string, unterminated boolean"
ENTRY = "struct<filename_hash:bigint,sequence:smallint,hash_index:int,start_offset:bigint,end_offset:bigint>"


def result(value: str) -> str:
    """What a decoder returns for one row: a value or an error, never an exception."""
    return f"struct<ok:boolean,value:{value},error:{ERROR}>"
