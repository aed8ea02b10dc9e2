"""Schemas of the canonical frames, as DDL."""

MARKER = "struct<ord:int,offset:bigint,code:int,length:int>"
COMPONENT = "struct<component_idx:int,id:int,ss_x:int,ss_y:int,qtable_idx:int,width:int,height:int>"
QTABLE = "struct<table_id:int,q:array<smallint>>"
HUFF = "struct<class:int,slot:int,counts:array<int>,huffval:array<int>>"
SCAN_COMPONENT = "struct<sc:int,component_idx:int,dc_idx:int,ac_idx:int,mcu_x:int,mcu_y:int,data_x:int,data_y:int>"
SEGMENT = "struct<segment_idx:int,begin:bigint,end:bigint,num_bytes:bigint>"
SCAN = (
    "struct<scan_idx:int,begin:bigint,end:bigint,num_mcus_x:int,num_mcus_y:int,units_in_mcu:int,restart_interval:int,"
    f"components:array<{SCAN_COMPONENT}>,qtables:array<{QTABLE}>,huff_tables:array<{HUFF}>,segments:array<{SEGMENT}>>"
)
HEADER = (
    "image_id string, status string, precision int, width int, height int, num_components int, ss_max_x int, ss_max_y int, "
    f"restart_interval int, markers array<{MARKER}>, components array<{COMPONENT}>, scans array<{SCAN}>"
)
MCU_UNIT = "struct<component_idx:int,x_in:int,y_in:int,ss_x:int,ss_y:int,dc_idx:int,ac_idx:int>"
QUANT = "struct<component_idx:int,q:array<smallint>,width:int,height:int,ss_x:int,ss_y:int>"
DATA = "struct<segment_idx:int,subseq_offset:int,subseq_count:int,data:binary,first_mcu:bigint,num_mcus:bigint>"
#: Runs of a scan's segments, with what decoding them needs, once a run.
PARTS = f"image_row bigint, image_id string, scan_idx int, num_mcus_x int, mcu array<{MCU_UNIT}>, huff_tables array<{HUFF}>, quant array<{QUANT}>, segments array<{DATA}>"
UNITS = "image_id string, scan_idx int, unit bigint, segment_idx int, component_idx int, block_y int, block_x int, coef array<smallint>"
PIXEL_BLOCKS = "image_row bigint, image_id string, component_idx int, block_y int, block_x int, px array<smallint>, width int, height int, ss_x int, ss_y int"
PLANES = "image_row bigint, image_id string, component_idx int, width int, height int, ss_x int, ss_y int, data binary"
