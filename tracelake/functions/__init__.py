"""tracelake.functions"""
