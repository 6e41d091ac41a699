"""tabstat.functions"""
