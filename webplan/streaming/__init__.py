"""webplan.streaming"""
